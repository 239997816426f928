"""Operators for preparing training text, one module each, and their queries.

Nothing else in the library imports this package.
"""
