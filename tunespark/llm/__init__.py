"""Operators for preparing training data at scale: counting, filtering, near-duplicates, search, packing, sharding."""
