"""Drift and refresh: a stored table against what is live now.

Unlike a plan these compare strictly, over the union of columns, and never
report rows that exist only in the live table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.collections import any_of
from tablerecon.functions.compare import differs
from tablerecon.functions.hashing import row_hash
from tablerecon.plans.changes import TIMESTAMPS, _struct, key_names, moment


def _joined(old: DataFrame, new: DataFrame, names: Sequence[str], rest: Sequence[str], how: str) -> DataFrame:
    """Old rows beside their live row; live columns carry the prefix ``__n_``."""
    side = new.select(
        *[F.col(k).alias(f"__k_{k}") for k in names],
        *[F.col(c).alias(f"__n_{c}") for c in rest],
        F.lit(True).alias("__live"),
    )
    return old.join(side, [old[k] == side[f"__k_{k}"] for k in names], how)


def _changed(old: DataFrame, new: DataFrame, c: str) -> Column:
    in_old, in_new = c in old.columns, c in new.columns
    if in_old and in_new:
        return differs(F.col(c), F.col(f"__n_{c}"), old.schema[c].dataType, new.schema[c].dataType, "exact")
    return (F.col(c) if in_old else F.col(f"__n_{c}")).isNotNull()


def drift(
    old: DataFrame,
    new: DataFrame,
    keys: str | Sequence[str],
    exclude: Sequence[str] = TIMESTAMPS,
    whole_prior: bool = False,
) -> DataFrame:
    """``(<keys>, action, prior, planned, changed_fields)`` of changed rows only.

    A row gone from ``new`` is a delete, a differing row an update; a row that
    is not in ``old`` is ignored.  ``whole_prior`` puts excluded columns of ``old``
    into ``prior`` as well.
    """
    names = key_names(keys)
    old_rest = [c for c in old.columns if c not in names and c not in exclude]
    new_rest = [c for c in new.columns if c not in names and c not in exclude]
    shown = [c for c in old.columns if c not in names] if whole_prior else old_rest
    union = list(dict.fromkeys([*old_rest, *new_rest]))
    compared = _joined(old, new, names, new_rest, "left").withColumns(
        {f"__f_{c}": _changed(old, new, c) for c in union}
    )
    gone = F.col("__live").isNull()
    hit = compared.filter(gone | any_of([F.col(f"__f_{c}") for c in union]))
    listed = F.array(*[F.when(F.col(f"__f_{c}"), F.lit(c)) for c in union]).cast("array<string>")
    null_name = F.array(F.lit(None).cast("string"))
    return hit.select(
        *names,
        F.when(gone, "delete").otherwise("update").alias("action"),
        _struct({c: F.col(c) for c in shown or names}).alias("prior"),
        F.when(~gone, _struct({c: F.col(f"__n_{c}") for c in new_rest} or {k: F.col(k) for k in names})).alias(
            "planned"
        ),
        F.when(gone, F.array().cast("array<string>"))
        .otherwise(F.array_except(listed, null_name))
        .alias("changed_fields"),
    )


def refresh(
    state: DataFrame,
    live: DataFrame,
    keys: str | Sequence[str],
    now: Column | datetime | None = None,
    echo: Sequence[str] = (),
    hash_col: str | None = None,
    flag: str | None = None,
) -> DataFrame:
    """The state brought up to the live table.

    Rows that are no longer live go; a differing row takes the live values, those of
    columns the state lacks too, and a new ``updated_at``; live rows the state does not
    know are not adopted.
    ``echo`` columns keep the state's value and are never compared.  With
    ``flag`` the result says which rows were replaced.
    """
    names = key_names(keys)
    now = moment(now)
    skip = {*names, *TIMESTAMPS, *echo, *([hash_col] if hash_col else [])}
    attrs = [c for c in state.columns if c not in skip]
    more = [c for c in live.columns if c not in skip and c not in state.columns]
    live_attrs = [c for c in [*attrs, *more] if c in live.columns]
    changed = any_of([_changed(state, live, c) for c in [*attrs, *more]])
    joined = _joined(state, live, names, live_attrs, "inner").withColumn("__changed", changed)
    hit = F.col("__changed")
    out = []
    for c in state.columns:
        if c in attrs:
            value = F.col(f"__n_{c}") if c in live_attrs else F.lit(None).cast(state.schema[c].dataType)
            out.append(F.when(hit, value).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, now.cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    # A live value in a new column is a difference, so other rows hold null there.
    out.extend(F.col(f"__n_{c}").alias(c) for c in more)
    result = joined.select(*out, hit.alias("__changed"))
    if hash_col:
        hashed = row_hash(result, [*attrs, *more, *[e for e in echo if e in state.columns]])
        result = result.withColumn(hash_col, F.when(hit, hashed).otherwise(F.col(hash_col)))
    return result.withColumnRenamed("__changed", flag) if flag else result.drop("__changed")
