import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablerecon.errors import DuplicateKeyError, ReconError, StalePlanError, ValidationError
from tablerecon.operators.digest import table_digest
from tablerecon.plans import Plan, TableStore, load_plan, save_plan
from tablerecon.plans.changes import TIMESTAMPS
from tablerecon.session import scratch_path

DDL = "k string, v int, config map<string,string>"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def table(spark, *records):
    return spark.createDataFrame([(k, v, c) for k, v, c in records], DDL)


@pytest.fixture
def store(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k")
    s.create(table(spark, ("a", 1, {"x": "1"}), ("b", 2, {}), ("c", 3, {})), T0, lineage="line")
    return s


def content(store):
    return {r["k"]: (r["v"], r["config"], r["created_at"].month, r["updated_at"].month) for r in store.read().collect()}


def full_digest(store):
    at = store.require()
    return table_digest(store.read(), exclude=TIMESTAMPS, meta={"lineage": at.lineage, "serial": at.serial}).first()["digest"]


def test_round_trip(spark, store):
    desired = table(spark, ("a", 1, {}), ("b", 5, {"n": "1"}), ("d", 4, {}))
    first = store.current()
    made = store.plan(desired)
    after = store.apply(made, T1)
    assert content(store) == {"a": (1, {"x": "1"}, 1, 1), "b": (5, {"n": "1"}, 1, 6), "d": (4, {}, 6, 6)}
    assert (after.serial, after.seq, after.rows) == (first.serial + 3, 1, 3)
    # The digest follows from the changes, without reading the table again.
    assert after.digest == full_digest(store) != first.digest
    again = store.plan(desired)
    path = scratch_path(spark, "test-plan")
    save_plan(again, path)
    assert load_plan(spark, path).meta.counts == {"create": 0, "update": 0, "delete": 0, "no-op": 3}
    assert {r["action"] for r in again.changes.collect()} == {"no-op"}
    assert store.apply(again, T1) == after
    assert len(store.read(first).collect()) == 3


def test_destroy_and_recreate(spark, store):
    gone = store.apply(store.plan(table(spark), destroy=True), T1)
    assert (gone.rows, gone.serial) == (0, 3) and gone.digest == full_digest(store)
    back = store.apply(store.plan(table(spark, ("a", 1, {}))), T1)
    assert (back.rows, back.serial) == (1, 4)


def test_saved_plan_and_stale_reasons(spark, store):
    path = scratch_path(spark, "test-plan")
    save_plan(store.plan(table(spark, ("a", 9, {}))), path)
    loaded = load_plan(spark, path)
    assert loaded.stored and loaded.meta.serial == 0
    assert loaded.meta.counts == {"create": 0, "update": 1, "delete": 2, "no-op": 0}
    store.apply(loaded, T1)
    with pytest.raises(StalePlanError, match="serial changed"):
        store.apply(load_plan(spark, path), T1)
    fresh = store.plan(table(spark, ("a", 10, {})))
    moved = Plan(fresh.changes, type(fresh.meta)(**{**fresh.meta.__dict__, "lineage": "other"}))
    assert store.stale_reason(moved) == "lineage changed"
    moved = Plan(fresh.changes, type(fresh.meta)(**{**fresh.meta.__dict__, "digest": "0"}))
    assert store.stale_reason(moved) == "digest changed"
    assert store.stale_reason(fresh, verify=True) is None


def test_verify_finds_changed_files(spark, store):
    made = store.plan(table(spark, ("a", 9, {})))
    at = store.require()
    spark.createDataFrame([("z", 0, {}, T0, T0)], store.read().schema).write.mode("append").parquet(at.parts[0]["path"])
    assert store.stale_reason(made) is None
    assert store.stale_reason(made, verify=True) == "digest changed"
    with pytest.raises(StalePlanError, match="digest"):
        store.apply(made, T1, verify=True)


def test_refused_plans_write_nothing(spark, store):
    made = store.plan(table(spark, ("d", 1, {})))
    bad = Plan(made.changes.unionByName(made.changes), made.meta)
    with pytest.raises(ValidationError, match="plan_unique"):
        store.apply(bad)
    assert store.current().serial == 0 and len(content(store)) == 3
    with pytest.raises(DuplicateKeyError):
        store.plan(table(spark, ("a", 1, {}), ("a", 2, {})))
    with pytest.raises(ReconError, match="already holds"):
        store.create(table(spark))
    with pytest.raises(ReconError, match="no version"):
        TableStore(spark, scratch_path(spark, "nothing"), "k").require()


def test_refresh(spark, store):
    live = store.read().drop(*TIMESTAMPS)
    assert store.refresh(live) == (store.require(), False)
    moved = live.filter("k <> 'c'").withColumn("v", F.when(F.col("k") == "a", 7).otherwise(F.col("v")))
    version, changed = store.refresh(moved, T1)
    assert changed and version.serial == 1 and version.digest == full_digest(store)
    assert content(store) == {"a": (7, {"x": "1"}, 1, 6), "b": (2, {}, 1, 1)}


def test_variables_and_ignored_columns(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k", ignore=["depends_on"])
    ddl = "k string, path string, depends_on array<string>"
    s.create(spark.createDataFrame([("a", "PRJ/x", ["b"])], ddl), T0)
    desired = spark.createDataFrame([("a", "${p}/x", ["c"])], ddl)
    made = s.plan(desired, variables={"p": "PRJ"})
    assert [r["action"] for r in made.changes.collect()] == ["no-op"]


def test_a_small_apply_writes_the_changed_parts_only(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k", parts=8)
    s.create(table(spark, *[(f"k{i}", i, {}) for i in range(200)]), T0)
    before = {p["part"]: p for p in s.require().parts}
    assert len(before) == 8
    after = s.apply(s.plan(table(spark, ("k7", -1, {}), ("new", 1, {})), deletes=False), T1)
    moved = {p["part"] for p in after.parts if before[p["part"]] != p}
    assert 1 <= len(moved) <= 2 and after.digest == full_digest(s) and after.rows == 201
    assert moved == set(after.put)
    assert {r["k"]: r["v"] for r in s.read().collect()} == {**{f"k{i}": i for i in range(200)}, "k7": -1, "new": 1}
    version, changed = s.refresh(s.read().drop(*TIMESTAMPS).filter("k <> 'k9'"), T1)
    assert changed and version.rows == 200 and version.digest == full_digest(s)
    assert sum(p != q for p, q in zip(after.parts, version.parts, strict=True)) == 1


def test_null_keys_are_refused_at_once(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k")
    with pytest.raises(DuplicateKeyError, match="null"):
        s.create(table(spark, (None, 1, {}), ("a", 1, {})), T0)
    s.create(table(spark, ("a", 1, {})), T0)
    with pytest.raises(DuplicateKeyError, match="null"):
        s.plan(table(spark, (None, 1, {})))


def test_all_violations_can_be_read(spark, store):
    made = store.plan(table(spark, *[(f"n{i}", i, {}) for i in range(50)]))
    bad = Plan(made.changes.withColumn("desired", F.lit(None).cast(made.changes.schema["desired"].dataType)), made.meta)
    with pytest.raises(ValidationError) as caught:
        store.apply(bad)
    assert len(caught.value.messages) == 20 and caught.value.violations.count() == 50


def test_new_columns_join_the_table(spark, store):
    desired = store.read().drop(*TIMESTAMPS).withColumn("note", F.concat(F.lit("n-"), "k"))
    after = store.apply(store.plan(desired), T1)
    assert after.digest == full_digest(store)
    assert {r["k"]: r["note"] for r in store.read().collect()} == {"a": "n-a", "b": "n-b", "c": "n-c"}


def test_key_only_table(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k")
    s.create(spark.createDataFrame([("a",), ("b",)], "k string"), T0)
    after = s.apply(s.plan(spark.createDataFrame([("b",), ("c",)], "k string")), T1)
    assert sorted(r["k"] for r in s.read().collect()) == ["b", "c"]
    assert after.serial == 2 and after.digest == full_digest(s)
