"""Operators for large text corpora: packing, deduplication, search, filtering, extraction."""
