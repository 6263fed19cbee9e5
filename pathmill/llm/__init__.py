"""Operators for training-data pipelines: scoring, deduplication, fixity, decontamination, packing and sharding."""
