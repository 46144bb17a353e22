"""Operators that prepare training text: sharding, filtering, deduplication, scoring and packing."""
