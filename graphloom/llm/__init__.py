"""Training-data operators: dedup, sharding, scoring, tokenising and formatting.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so either half can be removed without touching the other.
"""
