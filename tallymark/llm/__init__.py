"""Operators for training-data pipelines: filtering, deduplication, extraction and tokens."""
