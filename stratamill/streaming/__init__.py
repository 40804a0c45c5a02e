"""Ordered emission of trials, as a stream and over finished tables."""
