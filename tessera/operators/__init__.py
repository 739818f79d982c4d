"""Operators on DataFrames. `ord` columns carry input order wherever "first" has a meaning."""
