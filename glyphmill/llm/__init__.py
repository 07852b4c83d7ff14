"""Training-data operators: sharding, dedup, language id, packing, mixing, quality, scans.

Nothing else in the library imports this subpackage.
"""
