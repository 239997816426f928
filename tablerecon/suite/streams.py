"""Incremental variants: streams run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.plans import TableStore
from tablerecon.session import scratch_path
from tablerecon.streaming import apply_stream, file_stream, sync_stream
from tablerecon.suite.registry import Tables, query


def _events(t: Tables) -> DataFrame:
    """The events file as a stream: a folder watched for one name."""
    return file_stream(t.spark, t.dir, t.events.schema, options={"pathGlobFilter": "events.parquet"})


@query("SELECT event_id, user_id, event_type, props FROM events")
def stream_sync_events(t: Tables) -> DataFrame:
    """Copied once; a second run finds nothing new."""
    target, checkpoint = scratch_path(t.spark, "synced"), scratch_path(t.spark, "checkpoint")
    for _ in range(2):
        sync_stream(_events(t), target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type", "props")


@query(
    """WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(l.event_type, 'none') AS event_type,
  CAST(CASE WHEN l.user_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS touched
FROM customer LEFT JOIN last l ON l.user_id = c_custkey
UNION ALL SELECT user_id, event_type, 1 FROM last WHERE user_id NOT IN (SELECT c_custkey FROM customer)"""
)
def stream_apply_latest(t: Tables) -> DataFrame:
    """Each user's latest event upserted into a table of customers."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    store = TableStore(t.spark, scratch_path(t.spark, "users"), "user_id")
    store.create(t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type")), stamp)
    source = _events(t).select("user_id", "event_type", "event_id")
    later = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    checkpoint = scratch_path(t.spark, "checkpoint")
    apply_stream(source, store, "event_id", checkpoint, now=later).awaitTermination()
    touched = (F.col("updated_at") == later).cast("int")
    return store.read().select("user_id", "event_type", touched.alias("touched"))
