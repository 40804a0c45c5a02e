"""Readers of bars, trials and candidate lists."""
