"""Row and null counts, and emptiness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.errors import EmptyTableError


def qa_sql(
    df: DataFrame, cols: Sequence[str], total: str = "total_rows", stamp: str | None = None
) -> DataFrame:
    """One row: row count and null count per column.

    Like the SQL it stands for, an empty input gives count 0 and null sums.
    """
    sums = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"missing_{c}") for c in cols]
    out = df.agg(F.count(F.lit(1)).alias(total), *sums)
    return out.select(F.current_timestamp().alias(stamp), "*") if stamp else out


def qa_frame(df: DataFrame, cols: Sequence[str], total: str = "total_rows") -> DataFrame:
    """Same counts, but an empty input gives no row."""
    return qa_sql(df, cols, total).filter(F.col(total) > 0)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def assert_not_empty(df: DataFrame, name: str = "table") -> DataFrame:
    """Raise when there is no row; reads one row at most."""
    if df.isEmpty():
        raise EmptyTableError(f"{name} is empty")
    return df


def not_empty_report(**frames: DataFrame) -> DataFrame:
    """One row per table: its name and whether it has any row."""
    parts = [
        df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(
            F.lit(name).alias("table_name"), "has_rows"
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
