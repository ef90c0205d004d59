"""Operators on DataFrames: records, field lookup, integrity checks, code tables."""
