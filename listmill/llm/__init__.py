"""Operators for training-data pipelines: search, redaction, de-duplication, formatting, encoding, sharding, packing."""
