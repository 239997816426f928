"""JSON and variant column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAMS_PREFIX = "params."


def variant_path(path: str) -> str:
    """``a.b`` as a variant path; every segment is an object key."""
    steps = []
    for segment in path.split("."):
        quote = "'" if "'" not in segment else '"'
        if quote in segment:
            raise ValueError(f"path segment {segment!r} mixes both quotes")
        steps.append(f"[{quote}{segment}{quote}]")
    return "$" + "".join(steps)


def path_get(doc: Column, path: str, default: object = None, type: str = "string") -> Column:
    """Value of a dotted path in a variant column.

    The default stands in only when the path is missing; a JSON null that is
    present comes back as null.
    """
    where = variant_path(path)
    found = F.try_variant_get(doc, where, "variant")
    return (
        F.when(found.isNull(), F.lit(default).cast(type))
        .when(F.is_variant_null(found), F.lit(None).cast(type))
        .otherwise(F.try_variant_get(doc, where, type))
    )


def parse(col: Column) -> Column:
    """JSON text to variant; null for text that is not JSON."""
    return F.try_parse_json(col)


def extract_attrs(
    df: DataFrame,
    json_col: str,
    spec: Mapping[str, tuple],
    keep: list[str] | None = None,
) -> DataFrame:
    """Project many paths out of one JSON column, parsed once per row.

    ``spec`` maps the output name to ``(path,)``, ``(path, type)`` or
    ``(path, type, default)``.
    """
    dtype = df.schema[json_col].dataType
    doc = F.col(json_col) if isinstance(dtype, T.VariantType) else parse(F.col(json_col))
    kept = df.columns if keep is None else keep
    parsed = df.select(*kept, doc.alias("__doc"))
    fields = []
    for name, entry in spec.items():
        path, kind, default = (*entry, *("string", None)[len(entry) - 1 :])
        fields.append(path_get(F.col("__doc"), path, default, kind).alias(name))
    return parsed.select(*kept, *fields)


def build_params(fields: Mapping[str, Column], prefix: str = PARAMS_PREFIX) -> Column:
    """JSON object of the fields whose path starts with ``prefix``, nulls left out."""
    chosen = [
        col.alias(path[len(prefix) :]) for path, col in fields.items() if path.startswith(prefix)
    ]
    return F.to_json(F.struct(*chosen)) if chosen else F.lit("{}")


def _six_digits(col: Column) -> Column:
    """A local timestamp as ``2024-06-01T00:00:00.000000``."""
    parts = F.split(F.replace(col.cast("string"), F.lit(" "), F.lit("T")), r"\.")
    fraction = F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 6, "0")
    return F.concat(F.get(parts, F.lit(0)), F.lit("."), fraction)


def ordered(col: Column, dtype: T.DataType) -> Column:
    """Same value with struct fields and map keys in sorted order, at every level."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[ordered(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: ordered(x, dtype.elementType))
    # JSON's own timestamps stop at milliseconds and follow the session's time zone.
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        return _six_digits(col)
    if isinstance(dtype, T.MapType):
        by_key = F.array_sort(
            F.map_entries(col),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
        pairs = F.transform(
            by_key,
            lambda e: F.struct(e["key"].alias("k"), ordered(e["value"], dtype.valueType).alias("v")),
        )
        return F.map_from_entries(pairs)
    return col


def canonical_json(col: Column, dtype: T.DataType | None = None) -> Column:
    """JSON text with sorted keys, no whitespace, and nulls written out.

    Timestamps are whole: microseconds since the epoch, or six digits for local ones.

    Text columns are read as JSON documents; others are encoded by type.
    """
    if dtype is None or isinstance(dtype, T.StringType):
        return F.to_json(parse(col))
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return F.to_json(ordered(col, dtype), {"ignoreNullFields": "false"})


def as_text(col: Column, dtype: T.DataType) -> Column:
    """A value as text: nested types as canonical JSON."""
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return canonical_json(col, dtype)
    return col.cast("string")
