"""Structured Streaming forms of the roll-up and of the refresh."""
