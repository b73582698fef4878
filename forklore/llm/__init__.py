"""Operators for building training corpora: deduplication, search, filtering, mixing, packing.

Nothing else in the library imports this package.
"""
