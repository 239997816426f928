"""Array and map column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(col: Column, dtype: T.DataType) -> Column:
    """Null becomes ``[]``, a scalar ``[x]``, a list stays."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(col, F.array().cast(dtype))
    return F.when(col.isNull(), F.array().cast(T.ArrayType(dtype))).otherwise(F.array(col))


def tag_value(tags: Column, prefix: str) -> Column:
    """The first tag with the prefix, without it; null if there is none."""
    first = F.try_element_at(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(1))
    return F.substr(first, F.lit(len(prefix) + 1))


def tag_add(tags: Column, *new: Column | str) -> Column:
    """Set union with the new tags, sorted."""
    extra = F.array(*[F.lit(t) if isinstance(t, str) else t for t in new])
    have = F.coalesce(tags, F.array().cast("array<string>"))
    return F.sort_array(F.array_union(have, extra))


def dedupe_keep_order(col: Column) -> Column:
    return F.array_distinct(col)


def targets_of(rules: Column, field: str = "targetProject") -> Column:
    """Distinct non-null targets of a rule list, sorted."""
    names = F.transform(F.coalesce(rules, F.array()), lambda r: r[field])
    return F.sort_array(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))


def merge_map(current: Column, desired: Column) -> Column:
    """Right side wins, other keys are kept; null counts as an empty map."""
    kept = F.map_filter(current, lambda k, _v: ~F.map_contains_key(desired, k))
    return (
        F.when(desired.isNull(), current)
        .when(current.isNull(), desired)
        .otherwise(F.map_concat(kept, desired))
    )


def nested_upsert(
    entries: Column, matches: Callable[[Column], Column], replace: Callable[[Column], Column], new: Column
) -> Column:
    """Rewrite the first matching entry in place, or append ``new``."""
    at = F.array_position(F.transform(entries, matches), F.lit(True))
    rewritten = F.transform(
        entries, lambda e, i: F.when(i + 1 == at, replace(e)).otherwise(e)
    )
    return (
        F.when(entries.isNull(), F.array(new))
        .when(at > 0, rewritten)
        .otherwise(F.concat(entries, F.array(new)))
    )


def nested_remove(entries: Column, matches: Callable[[Column], Column]) -> Column:
    """Drop every matching entry."""
    return F.filter(entries, lambda e: ~F.coalesce(matches(e), F.lit(False)))


def any_of(flags: Sequence[Column]) -> Column:
    """OR over columns; false for none."""
    out = F.lit(False)
    for i, flag in enumerate(flags):
        out = flag if i == 0 else out | flag
    return out
