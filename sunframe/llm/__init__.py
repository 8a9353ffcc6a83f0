"""Operators for training-data pipelines: search, packing, deduplication, language, scoring, privacy."""
