"""Operators of a training-data pipeline: scoring, filtering, deduplication, search, extraction, packing."""
