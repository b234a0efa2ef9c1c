"""Operators for building training data: filtering, near-duplicates, mixing, packing, archives."""
