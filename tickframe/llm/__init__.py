"""Operators for large training-data pipelines: scoring, deduplication, decontamination, mixing."""
