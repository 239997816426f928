"""Operators over DataFrames: schemas, lookups, checks, digests, graphs."""
