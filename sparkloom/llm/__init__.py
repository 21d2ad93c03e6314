"""Operators for preparing training data: scoring, filtering, deduplication, mixing, tokenising and packing."""
