import datetime as dt

from pyspark.sql import functions as F

from tablerecon.plans import TableStore
from tablerecon.session import scratch_path
from tablerecon.streaming import apply_batch, apply_stream, file_stream, latest_per_key, sync_stream

DDL = "k string, v int, seq int"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def feed(spark, path, *records):
    spark.createDataFrame(list(records), DDL).coalesce(1).write.mode("append").parquet(path)


def test_sync_stream_copies_only_what_is_new(spark):
    src, dst, ck = (scratch_path(spark, x) for x in ("src", "dst", "ck"))
    schema = spark.createDataFrame([], DDL).schema
    for n, record in enumerate([("a", 1, 1), ("b", 2, 2)], 1):
        feed(spark, src, record)
        sync_stream(file_stream(spark, src, schema), dst, ck).awaitTermination()
        assert spark.read.parquet(dst).count() == n
    sync_stream(file_stream(spark, src, schema), dst, ck).awaitTermination()
    assert spark.read.parquet(dst).count() == 2


def test_latest_per_key(spark):
    batch = spark.createDataFrame([("a", 1, 1), ("a", 3, 3), ("a", 2, 2), ("b", None, 1)], DDL)
    got = {r["k"]: (r["v"], r["seq"]) for r in latest_per_key(batch, "k", "seq").collect()}
    assert got == {"a": (3, 3), "b": (None, 1)}
    assert latest_per_key(batch, "k", "seq").columns == batch.columns


def test_apply_stream(spark):
    src, ck = scratch_path(spark, "src"), scratch_path(spark, "ck")
    store = TableStore(spark, scratch_path(spark, "store"), "k")
    store.create(spark.createDataFrame([("a", 1), ("z", 9)], "k string, v int"), T0)
    schema = spark.createDataFrame([], DDL).schema
    feed(spark, src, ("a", 5, 1), ("a", 7, 2), ("b", 1, 1))
    apply_stream(file_stream(spark, src, schema), store, "seq", ck, now=T1).awaitTermination()
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 7, "b": 1, "z": 9}
    assert store.require().serial == 2
    feed(spark, src, ("b", 2, 9))
    apply_stream(file_stream(spark, src, schema), store, "seq", ck, now=T1).awaitTermination()
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 7, "b": 2, "z": 9}
    assert (store.require().serial, store.require().seq) == (3, 2)


def test_replayed_and_empty_batches(spark):
    store = TableStore(spark, scratch_path(spark, "store"), "k")
    store.create(spark.createDataFrame([("a", 1)], "k string, v int"), T0)
    batch = spark.createDataFrame([("a", 2, 1)], DDL)
    assert apply_batch(store, batch, "s-0", "seq", T1)
    assert not apply_batch(store, batch.withColumn("v", F.lit(99)), "s-0", "seq", T1)
    assert store.read().first()["v"] == 2 and store.require().serial == 1
    before = store.require()
    assert apply_batch(store, batch, "s-1", "seq", T1)
    now = store.require()
    assert (now.serial, now.parts, now.seq) == (before.serial, before.parts, before.seq + 1)
    assert not apply_batch(store, batch, "s-1", "seq", T1)
