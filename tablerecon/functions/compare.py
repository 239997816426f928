"""Field comparison as column expressions, built from the column types.

Strategies:

``partial`` (default)
    Maps, structs and JSON objects compare only what *desired* holds, level by
    level; a key missing in *prior* counts as null.  Lists compare strictly.
``exact``
    Strict equality; extra or missing map keys differ.
``set``
    Lists compare as sets; anything else strictly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.collections import any_of
from tablerecon.functions.nested import json_differs

STRATEGIES = ("partial", "exact", "set")


def opaque(dtype: T.DataType) -> bool:
    """Whether Spark has no ``=`` for the type or a type inside it."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return opaque(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(opaque(f.dataType) for f in dtype.fields)
    return False


def comparable(col: Column, dtype: T.DataType) -> Column:
    """The same value in a form that can be compared and sorted."""
    if not opaque(dtype):
        return col
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: comparable(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(col)
        if opaque(dtype.valueType):
            entries = F.transform(
                entries,
                lambda e: F.struct(
                    e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value")
                ),
            )
        return F.array_sort(entries)
    assert isinstance(dtype, T.StructType)
    rebuilt = F.struct(*[comparable(col[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return F.when(col.isNotNull(), rebuilt)


def _strict(desired: Column, prior: Column, dtype: T.DataType, prior_type: T.DataType) -> Column:
    return ~comparable(desired, dtype).eqNullSafe(comparable(prior, prior_type))


def _null_or(desired: Column, prior: Column, inner: Column) -> Column:
    either = desired.isNull() | prior.isNull()
    return F.when(either, desired.isNull() != prior.isNull()).otherwise(inner)


def _partial(desired: Column, prior: Column, dtype: T.DataType, prior_type: T.DataType) -> Column:
    if isinstance(dtype, T.StructType) and isinstance(prior_type, T.StructType):
        have = {f.name: f.dataType for f in prior_type.fields}
        flags = [
            _partial(desired[f.name], prior[f.name], f.dataType, have[f.name])
            if f.name in have
            else desired[f.name].isNotNull()
            for f in dtype.fields
        ]
        return _null_or(desired, prior, any_of(flags))
    if isinstance(dtype, T.MapType) and isinstance(prior_type, T.MapType):
        inner = F.exists(
            F.map_entries(desired),
            lambda e: _partial(
                e["value"],
                F.try_element_at(prior, e["key"]),
                dtype.valueType,
                prior_type.valueType,
            ),
        )
        return _null_or(desired, prior, inner)
    if isinstance(dtype, T.VariantType) and isinstance(prior_type, T.VariantType):
        return json_differs(desired, prior)
    return _strict(desired, prior, dtype, prior_type)


def differs(
    desired: Column,
    prior: Column,
    dtype: T.DataType,
    prior_type: T.DataType | None = None,
    strategy: str = "partial",
) -> Column:
    """Boolean column, never null: does *desired* differ from *prior*?"""
    prior_type = prior_type or dtype
    if strategy == "exact":
        return _strict(desired, prior, dtype, prior_type)
    if strategy == "set":
        if isinstance(dtype, T.ArrayType) and isinstance(prior_type, T.ArrayType):
            left = F.sort_array(F.array_distinct(comparable(desired, dtype)))
            right = F.sort_array(F.array_distinct(comparable(prior, prior_type)))
            return ~left.eqNullSafe(right)
        return _strict(desired, prior, dtype, prior_type)
    if strategy == "partial":
        return _partial(desired, prior, dtype, prior_type)
    raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
