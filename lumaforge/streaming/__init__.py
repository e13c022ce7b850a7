"""Structured Streaming jobs over arriving files and events."""
