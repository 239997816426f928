"""Incremental copies and incremental apply on Structured Streaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablerecon.plans.changes import key_names
from tablerecon.plans.store import TableStore


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**(options or {})).load(path)


def sync_stream(
    source: DataFrame,
    target: str,
    checkpoint: str,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Copy what is new since the last run, exactly once, then stop."""
    writer = source.writeStream.format(format).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(availableNow=True).start(target)


def latest_per_key(batch: DataFrame, keys: str | Sequence[str], order: str) -> DataFrame:
    """The latest row of each key.

    An aggregation, not a window: a hot key is reduced to one row per task
    before the shuffle.
    """
    names = key_names(keys)
    rest = [c for c in batch.columns if c not in names]
    latest = batch.groupBy(*names).agg(F.max_by(F.struct(*rest), F.struct(order, *[
        c for c in rest if c != order and _sortable(batch.schema[c].dataType)
    ])).alias("__row"))
    return latest.select(*names, *[F.col("__row")[c].alias(c) for c in rest]).select(*batch.columns)


def _sortable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType, T.StructType, T.ArrayType))


def apply_batch(
    store: TableStore, batch: DataFrame, batch_id: str, order: str, now: Column | datetime | None = None
) -> bool:
    """Upsert one micro-batch into the store; False if it was done before.

    A key missing from the batch is not a delete.  Of each key and column the value of the
    highest ``order`` counts, whatever batches the rows come in; see ``TableStore.upsert``.
    The batch's number is recorded with the version, so a replayed batch is skipped.
    """
    if store.done(batch_id):
        return False
    store.upsert(batch, order, now=now, batch=batch_id)
    return True


def apply_stream(
    source: DataFrame,
    store: TableStore,
    order: str,
    checkpoint: str,
    name: str = "apply",
    now: Column | datetime | None = None,
) -> StreamingQuery:
    """Apply every micro-batch of ``source`` to the store, then stop."""

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, f"{name}-{batch_id}", order, now)

    return (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
