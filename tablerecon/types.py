"""Declared column types and column declarations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

# The ten declarable type names.
DECLARED_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "array": T.ArrayType(T.StringType()),
    "object": T.VariantType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}

# Dataset types with a SQL connection.
SQL_TYPES = ("PostgreSQL", "Snowflake", "Oracle", "MySQL")


@dataclass(frozen=True)
class Column:
    """A declared column: one of the ten names, or any Spark DDL type."""

    name: str
    type: str = "string"
    description: str = ""
    meaning: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a column needs a name")

    def data_type(self, date_as: str = "date") -> T.DataType:
        if self.type == "date" and date_as != "date":
            return T.DataType.fromDDL(date_as)
        known = DECLARED_TYPES.get(self.type)
        return known if known is not None else T.DataType.fromDDL(self.type)

    def metadata(self) -> dict[str, str]:
        meta = {"comment": self.description}
        if self.meaning is not None:
            meta["meaning"] = self.meaning
        return meta

    def field(self, date_as: str = "date") -> T.StructField:
        return T.StructField(self.name, self.data_type(date_as), True, self.metadata())


def as_columns(columns: Iterable[Column | tuple | str]) -> list[Column]:
    """Accept ``Column``, ``(name, type, ...)`` tuples and plain names."""
    out = []
    for c in columns:
        if isinstance(c, Column):
            out.append(c)
        elif isinstance(c, str):
            out.append(Column(c))
        else:
            out.append(Column(*c))
    return out


def declared_schema(columns: Iterable[Column | tuple | str], date_as: str = "date") -> T.StructType:
    return T.StructType([c.field(date_as) for c in as_columns(columns)])


def columns_of(schema: T.StructType) -> list[Column]:
    """Describe an existing schema, with the defaults for missing metadata."""
    names = {v.simpleString(): k for k, v in DECLARED_TYPES.items()}
    return [
        Column(
            f.name,
            names.get(f.dataType.simpleString(), f.dataType.simpleString()),
            f.metadata.get("comment", ""),
            f.metadata.get("meaning"),
        )
        for f in schema.fields
    ]
