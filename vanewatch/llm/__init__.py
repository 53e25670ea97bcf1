"""Operators of a training-data pipeline: documents, pages, conversations and benchmarks."""
