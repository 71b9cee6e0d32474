"""Corpus operators for training-data pipelines: filters, search, deduplication, scoring and packing."""
