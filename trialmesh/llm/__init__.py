"""Operators of a training-data pipeline: archives, deduplication, filtering, mixing, tokens and packing."""
