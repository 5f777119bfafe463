"""Operators for training-data pipelines: deduplication, mixing, scans, quality, packing and sharding."""
