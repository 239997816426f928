"""Checked queries over the given tables, grouped as the library is."""

from tablerecon.suite import checks, digests, flows, functions, graphs, lookups, plans, stores, streams
from tablerecon.suite.registry import REGISTRY, Query, Tables

__all__ = [
    "REGISTRY",
    "Query",
    "Tables",
    "checks",
    "digests",
    "flows",
    "functions",
    "graphs",
    "lookups",
    "plans",
    "stores",
    "streams",
]
