"""Structured Streaming variants of the corpus counts."""
