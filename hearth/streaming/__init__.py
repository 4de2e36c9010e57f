"""Structured Streaming forms of the per-request work."""
