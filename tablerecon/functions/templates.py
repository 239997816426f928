"""``${name}`` substitution, applied variable by variable in order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Variables = Mapping[str, str] | Sequence[tuple[str, str]]

# Beyond this many variables the replacements loop over a literal array
# instead of nesting one expression per variable.
_NEST_LIMIT = 32


def _pairs(variables: Variables) -> list[tuple[str, str]]:
    return list(variables.items()) if isinstance(variables, Mapping) else list(variables)


def _marker(name: str) -> str:
    return "${" + name + "}"


def _text(col: Column, pairs: list[tuple[str, str]]) -> Column:
    if len(pairs) <= _NEST_LIMIT:
        for name, value in pairs:
            col = F.replace(col, F.lit(_marker(name)), F.lit(value))
        return col
    table = F.array(
        *[F.struct(F.lit(_marker(k)).alias("k"), F.lit(v).alias("v")) for k, v in pairs]
    )
    return F.aggregate(table, col, lambda acc, e: F.replace(acc, e["k"], e["v"]))


def has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return has_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(has_text(f.dataType) for f in dtype.fields)
    return False


def substitute(col: Column, variables: Variables, dtype: T.DataType | None = None) -> Column:
    """Replace markers in strings, list elements and map or struct values.

    A value that itself contains a *later* variable's marker is replaced again;
    unknown markers, map keys and non-text values stay as they are.
    """
    pairs = _pairs(variables)
    dtype = dtype or T.StringType()
    if not pairs or not has_text(dtype):
        return col
    if isinstance(dtype, T.StringType):
        return _text(col, pairs)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: substitute(x, pairs, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: substitute(v, pairs, dtype.valueType))
    assert isinstance(dtype, T.StructType)
    rebuilt = F.struct(
        *[substitute(col[f.name], pairs, f.dataType).alias(f.name) for f in dtype.fields]
    )
    return F.when(col.isNotNull(), rebuilt)


def substitute_columns(
    df: DataFrame, variables: Variables, columns: Sequence[str] | None = None
) -> DataFrame:
    """Substitute in the given columns, or in every column that holds text."""
    chosen = {
        f.name: substitute(F.col(f.name), variables, f.dataType)
        for f in df.schema.fields
        if (columns is None or f.name in columns) and has_text(f.dataType)
    }
    return df.withColumns(chosen) if chosen else df
