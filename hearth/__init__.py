"""Dialogue analytics on Spark: corpus preparation, retrieval, memory, safety, evaluation."""
