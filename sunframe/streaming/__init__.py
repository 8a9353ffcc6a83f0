"""Structured Streaming jobs. Every step is a DataFrame -> DataFrame function that also runs on a batch."""
