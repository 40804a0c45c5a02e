"""Operators over trials, curves and studies."""
