"""Operators for training data: splitting, neighbours, provenance, near copies, pairs, packing, leaks, subjects."""
