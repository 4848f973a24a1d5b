"""Corpus operators: quality, mixing, near-duplicates, toxicity, search, sharding, token files, packing.

Nothing else in the library imports this subpackage.
"""
