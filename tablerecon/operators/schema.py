"""Declared schemas: projection, casts, metadata and strict checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import ValidationError
from tablerecon.types import Column, as_columns, columns_of


def _convert(col: SparkColumn, source: T.DataType, target: T.DataType) -> SparkColumn:
    if source == target:
        return col
    if isinstance(target, T.VariantType):
        if isinstance(source, T.StringType):
            return F.try_parse_json(col)
        if isinstance(source, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_variant_object(col)
        return col.cast(target)
    if isinstance(target, (T.ArrayType, T.MapType, T.StructType)) and isinstance(
        source, T.StringType
    ):
        return F.from_json(col, target)
    return col.try_cast(target)


def schema_mismatch(df: DataFrame, columns: Iterable[Column | tuple | str]) -> list[str]:
    """Differences between the declared ordered column list and the frame's."""
    wanted = as_columns(columns)
    have = columns_of(df.schema)
    out = []
    for i in range(max(len(wanted), len(have))):
        w = wanted[i] if i < len(wanted) else None
        h = have[i] if i < len(have) else None
        if w != h:
            out.append(f"column {i}: declared {w}, found {h}")
    return out


def conform_schema(
    df: DataFrame,
    columns: Iterable[Column | tuple | str],
    strict: bool = False,
    date_as: str = "date",
) -> DataFrame:
    """Project and cast to the declared columns; no columns means leave alone.

    A value that cannot be cast becomes null, a column that is not there a null
    column.  Description and meaning go into the field metadata.  ``strict``
    refuses any difference instead of converting.
    """
    wanted = as_columns(columns)
    if not wanted:
        return df
    if strict:
        problems = schema_mismatch(df, wanted)
        if problems:
            raise ValidationError(problems)
        return df
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in wanted:
        target = c.data_type(date_as)
        if c.name in have:
            value = _convert(F.col(c.name), have[c.name], target)
        else:
            value = F.lit(None).cast(target)
        out.append(value.alias(c.name, metadata=c.metadata()))
    return df.select(*out)
