"""The change set: what to create, update, delete or leave.

``plan`` is one full outer join of *desired* and *prior* on their keys.  A
change row is::

    <keys...>, action, desired, planned, prior, changed_fields

``desired`` holds the declared values, ``planned`` the same after variables,
``prior`` the stored row (null for creates).  Both sides hold one row per key,
so keys cannot be skewed; ``check_keys`` proves it with an aggregation over the
key columns alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import DuplicateKeyError
from tablerecon.functions.collections import any_of
from tablerecon.functions.compare import differs
from tablerecon.functions.documents import as_text
from tablerecon.functions.templates import Variables, substitute
from tablerecon.operators.checks import check_keys as keys_at_fault

# The four actions.
ACTIONS = ("create", "update", "delete", "no-op")
ACTIONABLE = ("create", "update", "delete")

TIMESTAMPS = ("created_at", "updated_at")


def key_names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def refuse_duplicates(df: DataFrame, keys: str | Sequence[str], side: str) -> None:
    """Raise when a key occurs twice or holds a null.  Reads the key columns only."""
    row = keys_at_fault(df, keys).first()
    if row is not None:
        raise DuplicateKeyError(f"{side}: key {row['key']} does not name one row ({row['message']})")


def moment(now: Column | datetime | None) -> Column:
    """A point in time as a column; none means the time of the query."""
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def _struct(cols: Mapping[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def plan(
    desired: DataFrame,
    prior: DataFrame,
    keys: str | Sequence[str],
    strategies: Mapping[str, str] | None = None,
    ignore: Sequence[str] = (),
    null_desired: str = "unmanaged",
    variables: Variables | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """Classify every key of both sides.

    strategies    comparison per column, see ``functions.compare``
    ignore        columns carried along but not compared
    null_desired  ``unmanaged``: a null desired value is not compared;
                  ``value``: null is a value like any other
    variables     replaced in desired text before comparing
    check_keys    prove first that each side's keys are unique

    A null in a key fails when the row's action is read, also without that proof.
    """
    if null_desired not in ("unmanaged", "value"):
        raise ValueError("null_desired is 'unmanaged' or 'value'")
    names = key_names(keys)
    if check_keys:
        refuse_duplicates(desired, names, "desired")
        refuse_duplicates(prior, names, "prior")
    strategies = dict(strategies or {})
    d_types = {f.name: f.dataType for f in desired.schema.fields if f.name not in names}
    p_types = {f.name: f.dataType for f in prior.schema.fields if f.name not in names}

    # Columns cross the join one by one, not packed into structs: what a caller
    # does not use is pruned from the scans.  Presence is a literal per side,
    # because a key column may not be tested for null.
    left = desired.select(
        *[F.col(k).alias(f"__dk_{k}") for k in names],
        *[F.col(c).alias(f"__d_{c}") for c in d_types],
        F.lit(True).alias("__in_d"),
    )
    right = prior.select(
        *[F.col(k).alias(f"__pk_{k}") for k in names],
        *[F.col(c).alias(f"__p_{c}") for c in p_types],
        F.lit(True).alias("__in_p"),
    )
    joined = left.join(right, [F.col(f"__dk_{k}") == F.col(f"__pk_{k}") for k in names], "full_outer")

    resolved = {
        c: substitute(F.col(f"__d_{c}"), variables, t) if variables else F.col(f"__d_{c}")
        for c, t in d_types.items()
    }
    if variables:
        joined = joined.withColumns({f"__v_{c}": v for c, v in resolved.items()})
        resolved = {c: F.col(f"__v_{c}") for c in d_types}

    flags = {}
    for c, dtype in d_types.items():
        if c in ignore:
            continue
        want = resolved[c]
        if c in p_types:
            flag = differs(want, F.col(f"__p_{c}"), dtype, p_types[c], strategies.get(c, "partial"))
        else:
            flag = want.isNotNull()
        flags[c] = (want.isNotNull() & flag) if null_desired == "unmanaged" else flag
    staged = joined.withColumns({f"__f_{c}": flag for c, flag in flags.items()})

    # A table of nothing but keys shows them; an empty struct cannot be stored.
    d_cols = {c: F.col(f"__d_{c}") for c in d_types} or {k: F.col(f"__dk_{k}") for k in names}
    p_cols = {c: F.col(f"__p_{c}") for c in p_types} or {k: F.col(f"__pk_{k}") for k in names}
    in_d, in_p = F.col("__in_d").isNotNull(), F.col("__in_p").isNotNull()
    hit = any_of([F.col(f"__f_{c}") for c in flags])
    # Null keys meet nothing: the same row would be deleted and created for ever.
    no_key = any_of([F.coalesce(f"__dk_{k}", f"__pk_{k}").isNull() for k in names])
    refused = F.raise_error(F.lit("a key is null; see check_keys")).cast("string")
    action = (
        F.when(no_key, refused).when(~in_p, "create").when(~in_d, "delete").when(hit, "update").otherwise("no-op")
    )
    nothing = F.array().cast("array<string>")
    listed = F.array(*[F.when(F.col(f"__f_{c}"), F.lit(c)) for c in flags]).cast("array<string>")
    null_name = F.array(F.lit(None).cast("string"))
    return staged.select(
        *[F.coalesce(f"__dk_{k}", f"__pk_{k}").alias(k) for k in names],
        action.alias("action"),
        F.when(in_d, _struct(d_cols)).alias("desired"),
        F.when(in_d, _struct(resolved or d_cols)).alias("planned"),
        F.when(in_p, _struct(p_cols)).alias("prior"),
        F.when(in_d & in_p, F.array_except(listed, null_name)).otherwise(nothing).alias("changed_fields"),
    )


def plan_upserts(desired: DataFrame, prior: DataFrame, keys: str | Sequence[str], **options) -> DataFrame:
    """A plan without deletes: absence from *desired* says nothing.

    Prior is first reduced to the desired keys.  When those are few, as in a
    micro-batch, they are broadcast and the large table is not shuffled.
    """
    names = key_names(keys)
    met = prior.join(desired.select(*names), names, "left_semi")
    return plan(desired, met.select(*prior.columns), names, **options)


def plan_destroy(prior: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Every prior row becomes a delete; desired is not looked at."""
    names = key_names(keys)
    rest = {c: F.col(c) for c in prior.columns if c not in names} or {k: F.col(k) for k in names}
    return prior.select(*names, F.lit("delete").alias("action"), _struct(rest).alias("prior"))


def actionable(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("action") != "no-op")


def _counts(changes: DataFrame, actions: Sequence[str]) -> DataFrame:
    # Conditional sums always give one row, so missing actions come out as 0.
    sums = [
        F.coalesce(F.sum(F.when(F.col("action") == a, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"n{i}")
        for i, a in enumerate(actions)
    ]
    rows = F.array(
        *[F.struct(F.lit(a).alias("action"), F.col(f"n{i}").alias("rows")) for i, a in enumerate(actions)]
    )
    return changes.agg(*sums).select(F.inline(rows))


def summary(changes: DataFrame) -> DataFrame:
    """Rows per action, with zeros for actions that do not occur."""
    return _counts(changes, ACTIONS)


def summary_actionable(changes: DataFrame) -> DataFrame:
    """The same without no-ops."""
    return _counts(changes, ACTIONABLE)


def _struct_type(df: DataFrame, col: str) -> T.StructType:
    dtype = df.schema[col].dataType
    assert isinstance(dtype, T.StructType)
    return dtype


def diff_fields(changes: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``(<keys>, field, from, to)`` for every differing field of an update, as text."""
    names = key_names(keys)
    new = {f.name: f.dataType for f in _struct_type(changes, "planned").fields}
    old = {f.name: f.dataType for f in _struct_type(changes, "prior").fields}
    both = {**new, **old}

    def text(side: str, types: Mapping[str, T.DataType], c: str) -> Column:
        return as_text(F.col(side)[c], types[c]) if c in types else F.lit(None).cast("string")

    rows = F.array(
        *[
            F.when(
                F.array_contains("changed_fields", c),
                F.struct(
                    F.lit(c).alias("field"),
                    text("prior", old, c).alias("from"),
                    text("planned", new, c).alias("to"),
                ),
            )
            for c in both
        ]
    )
    updates = changes.filter(F.col("action") == "update")
    return updates.select(*names, F.inline(F.filter(rows, lambda r: r.isNotNull())))
