"""Operators of a training-data pipeline: mixing, packing, sharding, filtering, deduplication and search.

Nothing outside this subpackage imports it.
"""
