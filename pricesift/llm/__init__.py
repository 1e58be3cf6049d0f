"""Operators for training-data pipelines: cleaning, deduplication, scanning,
formatting and packing of text corpora. Nothing outside this subpackage imports it."""
