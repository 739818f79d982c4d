"""Operators of a training-data pipeline: deduplication, scoring, encoding, scans, formatting.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface and the thin registered query on top of it.
"""
