"""tablerecon: declarative table reconciliation and data flows on Spark."""

from tablerecon.errors import (
    DependencyCycleError,
    DuplicateKeyError,
    EmptyTableError,
    ReconError,
    StalePlanError,
    ValidationError,
)
from tablerecon.plans import TableStore, apply_changes, diff_fields, drift, plan, refresh, summary
from tablerecon.session import configure, local_session
from tablerecon.types import Column

__all__ = [
    "Column",
    "DependencyCycleError",
    "DuplicateKeyError",
    "EmptyTableError",
    "ReconError",
    "StalePlanError",
    "TableStore",
    "ValidationError",
    "apply_changes",
    "configure",
    "diff_fields",
    "drift",
    "local_session",
    "plan",
    "refresh",
    "summary",
]
