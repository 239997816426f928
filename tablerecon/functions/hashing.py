"""Row hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.documents import canonical_json


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of the given columns of ``df``."""
    names = sorted(columns if columns is not None else df.columns)
    dtype = T.StructType([df.schema[n] for n in names])
    return F.sha2(canonical_json(F.struct(*[F.col(n) for n in names]), dtype), 256)
