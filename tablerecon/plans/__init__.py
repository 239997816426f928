"""Plans: change sets, drift, refresh, apply, and the versioned table."""

from tablerecon.plans.apply import apply_changes, check_plan, next_serial, snapshot_of
from tablerecon.plans.changes import (
    actionable,
    diff_fields,
    plan,
    plan_destroy,
    summary,
    summary_actionable,
)
from tablerecon.plans.drift import drift, refresh
from tablerecon.plans.store import Plan, TableStore, Version, load_plan, save_plan

__all__ = [
    "Plan",
    "TableStore",
    "Version",
    "actionable",
    "apply_changes",
    "check_plan",
    "diff_fields",
    "drift",
    "load_plan",
    "next_serial",
    "plan",
    "plan_destroy",
    "refresh",
    "save_plan",
    "snapshot_of",
    "summary",
    "summary_actionable",
]
