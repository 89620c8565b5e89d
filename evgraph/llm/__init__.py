"""Operators of a training-data pipeline: sharding, deduplication, extraction, mixing, packing."""
