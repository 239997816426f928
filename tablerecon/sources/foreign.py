"""Foreign tables: local names for tables of other databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def resolve_name(ref: str, aliases: Mapping[str, str] | None = None) -> str:
    """An alias becomes its ``db.table``; anything else stays."""
    return (aliases or {}).get(ref, ref)


def read_foreign(spark: SparkSession, ref: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return spark.table(resolve_name(ref, aliases))
