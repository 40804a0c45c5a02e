"""The metric expression language."""
