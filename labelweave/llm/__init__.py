"""Operators of a training-data pipeline: mixing, fingerprints, search, deduplication, tokens."""
