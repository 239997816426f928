"""Turning a change set into the next snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.nested import conform, merged, widened
from tablerecon.operators.checks import _rows, check_keys, violations
from tablerecon.plans.changes import ACTIONS, TIMESTAMPS, key_names, moment


def _fields(df: DataFrame, col: str) -> dict[str, T.DataType]:
    if col not in df.columns:
        return {}
    dtype = df.schema[col].dataType
    assert isinstance(dtype, T.StructType)
    return {f.name: f.dataType for f in dtype.fields}


def _merged(
    new: Column,
    old: Column,
    dtype: T.DataType,
    old_type: T.DataType,
    want: T.DataType,
    strategy: str,
    null_desired: str,
) -> Column:
    """The stored value after an update: what is compared in part is stored in part."""
    value = merged(new, old, dtype, old_type, want) if strategy == "partial" else conform(new, dtype, want)
    rest = conform(old, old_type, want) if null_desired == "unmanaged" else F.lit(None).cast(want)
    return F.when(new.isNull(), rest).otherwise(value)


def next_columns(
    changes: DataFrame,
    keys: Sequence[str],
    snapshot: T.StructType,
    now: Column,
    strategies: Mapping[str, str] | None,
    null_desired: str,
) -> list[Column]:
    """The snapshot's columns after a change, from the change row alone."""
    strategies = strategies or {}
    planned, prior = _fields(changes, "planned"), _fields(changes, "prior")
    create, same = F.col("action") == "create", F.col("action") == "no-op"
    out = []
    for f in snapshot.fields:
        c = f.name
        nothing = F.lit(None).cast(f.dataType)
        new = conform(F.col("planned")[c], planned[c], f.dataType) if c in planned else nothing
        old = conform(F.col("prior")[c], prior[c], f.dataType) if c in prior else nothing
        if c in keys:
            value = F.col(c)
        elif c == "created_at":
            value = F.when(create, now.cast(f.dataType)).otherwise(old)
        elif c == "updated_at":
            value = F.when(same, old).otherwise(now.cast(f.dataType))
        elif c in planned and c in prior:
            after = _merged(
                F.col("planned")[c], F.col("prior")[c], planned[c], prior[c], f.dataType,
                strategies.get(c, "partial"), null_desired,
            )
            value = F.when(create, new).when(same, old).otherwise(after)
        elif c in planned:
            value = F.when(~same, new)
        else:
            value = F.when(~create, old)
        out.append(value.alias(c))
    return out


def new_rows(
    changes: DataFrame,
    keys: str | Sequence[str],
    snapshot: T.StructType,
    now: Column,
    strategies: Mapping[str, str] | None = None,
    null_desired: str = "unmanaged",
) -> DataFrame:
    """Created and updated rows, in the snapshot's column order.

    Everything they need is in the change row itself, so this is a narrow map.
    """
    touched = changes.filter(F.col("action").isin("create", "update"))
    return touched.select(
        *next_columns(changes, key_names(keys), snapshot, now, strategies, null_desired)
    )


def snapshot_schema(prior: DataFrame, changes: DataFrame) -> T.StructType:
    """Prior's columns, with the struct fields and then the columns that only the plan has."""
    have, planned = set(prior.columns), _fields(changes, "planned")
    known = [T.StructField(f.name, widened(f.dataType, planned.get(f.name, f.dataType))) for f in prior.schema.fields]
    extra = [T.StructField(c, t) for c, t in planned.items() if c not in have]
    return T.StructType([*known, *extra])


def apply_changes(
    prior: DataFrame,
    changes: DataFrame,
    keys: str | Sequence[str],
    now: Column | datetime | None = None,
    strategies: Mapping[str, str] | None = None,
    null_desired: str = "unmanaged",
) -> DataFrame:
    """The next snapshot: untouched rows plus new ones.

    The prior table is only anti-joined with the keys that change.  When few
    change Spark broadcasts them, and the table is copied without a shuffle.
    ``changes`` is read twice, so it should be a written one; ``snapshot_of``
    suits a change set that has just been computed.
    """
    names = key_names(keys)
    now = moment(now)
    schema = snapshot_schema(prior, changes)
    touched = changes.filter(F.col("action") != "no-op").select(*names)
    kept = prior.join(touched, names, "left_anti")
    have = {f.name: f.dataType for f in prior.schema.fields}
    kept = kept.select(
        *[
            (conform(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
    return kept.union(new_rows(changes, names, schema, now, strategies, null_desired))


def snapshot_of(
    changes: DataFrame,
    keys: str | Sequence[str],
    snapshot: T.StructType,
    now: Column | datetime | None = None,
    strategies: Mapping[str, str] | None = None,
    null_desired: str = "unmanaged",
) -> DataFrame:
    """The next snapshot from a change set that still holds its no-ops.

    The plan's join has met both sides already: one narrow map over it, and no
    second join.
    """
    now = moment(now)
    return changes.filter(F.col("action") != "delete").select(
        *next_columns(changes, key_names(keys), snapshot, now, strategies, null_desired)
    )


def with_timestamps(df: DataFrame, now: Column | datetime | None = None) -> DataFrame:
    """A first snapshot: both timestamps set."""
    now = moment(now)
    return df.withColumns({c: now for c in TIMESTAMPS})


def next_serial(version: DataFrame, changes: DataFrame) -> DataFrame:
    """``(lineage, serial)``: one step per applied change; none for no-ops.

    One aggregation over the stacked frames, so nothing is joined.
    """
    steps = changes.filter(F.col("action") != "no-op").select(
        F.lit(None).cast("string").alias("lineage"), F.lit(1).cast("long").alias("serial")
    )
    base = version.select(F.col("lineage").cast("string"), F.col("serial").cast("long"))
    return base.unionByName(steps).agg(F.max("lineage").alias("lineage"), F.sum("serial").alias("serial"))


def check_plan(changes: DataFrame, prior: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Violation rows of a change set about to be applied.

    Duplicate keys, unknown actions, creates and updates without desired
    values, and deletes or updates of rows the snapshot does not hold.
    """
    names = key_names(keys)
    todo = changes.filter(F.coalesce(F.col("action") != "no-op", F.lit(True)))
    unknown = _rows(
        todo.filter(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS)),
        "plan_action", names, F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null"))),
    )
    desired = F.col("desired") if "desired" in changes.columns else F.lit(None)
    missing = _rows(
        todo.filter(F.col("action").isin("create", "update") & desired.isNull()),
        "plan_desired", names, F.concat(F.lit("no desired row for "), F.col("action")),
    )
    # By the key columns themselves: their text would not tell composite keys apart.
    known = prior.select(*[F.col(k).alias(f"__k_{k}") for k in names])
    needs = todo.filter(F.col("action").isin("delete", "update")).select(*names, "action")
    match = [F.col(k) == F.col(f"__k_{k}") for k in names]
    absent = _rows(
        needs.join(known, match, "left_anti"),
        "plan_prior", names, F.concat(F.lit("no prior row for "), F.col("action")),
    )
    return violations(check_keys(todo, names, "plan_unique"), unknown, missing, absent)


def check_declared_keys(
    changes: DataFrame, keys: str | Sequence[str], declared: Sequence[str]
) -> DataFrame:
    """Creates and updates whose desired row names another key than the change."""
    names = key_names(keys)
    wrong = F.lit(False)
    for k, d in zip(names, declared, strict=True):
        wrong = wrong | ~F.col(k).eqNullSafe(F.col("desired")[d])
    bad = changes.filter(F.col("action").isin("create", "update") & F.col("desired").isNotNull() & wrong)
    return _rows(bad, "plan_key", names, F.lit("desired row has another key"))
