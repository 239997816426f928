"""Deltas, splits, order marks, several writers, the log, sweeps and drift by hash sums."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tablerecon.errors import ReconError, StalePlanError
from tablerecon.operators.digest import table_digest
from tablerecon.plans import TableStore, drift
from tablerecon.plans.changes import TIMESTAMPS
from tablerecon.plans.log import WHOLE_EVERY
from tablerecon.plans.store import grown
from tablerecon.session import scratch_path
from tablerecon.streaming import apply_batch

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def numbers(spark, n, **options):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k", **options)
    s.create(spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")), T0)
    return s


def content(s, *cols):
    return {r["k"]: tuple(r[c] for c in cols or ("v",)) for r in s.read().collect()}


def consistent(s):
    """The version's digest, counts and part sums against the rows themselves."""
    at = s.require()
    rows = s.read()
    assert at.rows == rows.count() == sum(p["rows"] for p in at.parts)
    want = table_digest(rows, exclude=TIMESTAMPS, meta={"lineage": at.lineage, "serial": at.serial}).first()["digest"]
    assert at.digest == want
    assert s.differing_parts(rows, at) == set()


def size(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows_of(spark, s, *records):
    return spark.createDataFrame(list(records), "k long, v long")


def test_a_batch_writes_its_own_rows(spark):
    s = numbers(spark, 20_000)
    table = size(f"{s.path}/data")
    keys = random.Random(1).sample(range(20_000), 40)
    after = s.apply(s.plan(rows_of(spark, s, *[(k, -1) for k in keys]), deletes=False), T1)
    assert all(p["deltas"] for p in after.parts) and sum(p["delta_rows"] for p in after.parts) == 80
    bases = {p["path"] for p in after.parts}
    written = spark.read.parquet(*[d for p in after.parts for d in p["deltas"]]).count()
    assert written == 40 and size(f"{s.path}/data") - table < table / 2
    assert bases == {p["path"] for p in s.version(0).parts}
    assert content(s) == {k: (-1 if k in keys else 10 * k,) for k in range(20_000)}
    consistent(s)


def test_reads_agree_before_and_after_compaction(spark):
    s, want = numbers(spark, 400, share=0.5, parts=4), {k: 10 * k for k in range(400)}
    rnd = random.Random(2)
    compacted = False
    for n in range(8):
        put = {rnd.randrange(440): n for _ in range(20)}
        drop = set(rnd.sample(sorted(want), 6)) - set(put)
        desired = rows_of(spark, s, *put.items())
        keep = s.read().select("k", "v").filter(~F.col("k").isin(*drop, *put))
        bases = {p["path"] for p in s.require().parts}
        after = s.apply(s.plan(keep.unionByName(desired)), T1)
        want = {k: v for k, v in want.items() if k not in drop} | put
        assert {k: v for k, (v,) in content(s).items()} == want
        compacted |= bool({p["path"] for p in after.parts} - bases)
        consistent(s)
    assert compacted and any(p["deltas"] for p in s.require().parts)
    assert content(s, "v") == {k: (v,) for k, v in want.items()}


def test_a_key_deleted_and_created_again(spark):
    s = numbers(spark, 100, share=10)
    whole = s.read().select("k", "v")
    s.apply(s.plan(whole.filter("k <> 5")), T1)
    assert 5 not in content(s)
    s.apply(s.plan(rows_of(spark, s, (5, 7)), deletes=False), T1)
    assert content(s)[5] == (7,) and len(content(s)) == 100
    consistent(s)


def test_layouts_that_grow():
    assert grown(8, 0, 100, 100) == (8, 0, [])
    assert grown(2, 0, 350, 100) == (4, 0, [(0, 2), (1, 2)])
    assert grown(2, 1, 500, 100) == (4, 1, [(1, 2), (0, 4)])


def test_parts_split_as_the_table_grows(spark):
    s = numbers(spark, 100, parts=2, part_rows=60)
    assert len(s.require().parts) == 2
    first = s.require()
    for start in (100, 130, 400):
        end = {100: 130, 130: 400, 400: 900}[start]
        new = spark.range(start, end).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        after = s.apply(s.plan(new, deletes=False), T1)
        assert content(s) == {k: (10 * k,) for k in range(end)}
        assert len(after.parts) == max(2, -(-end // 60)) == after.modulus + after.split
        consistent(s)
    assert len(s.read(first).collect()) == 100
    s.apply(s.plan(rows_of(spark, s, (7, 1), (899, 2)), deletes=False), T1)
    assert (content(s)[7], content(s)[899]) == ((1,), (2,))
    consistent(s)


STREAM = "k string, a int, b string, m map<string,int>, seq int"


def streamed(spark, batches, null_desired="unmanaged", first=()):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k", null_desired=null_desired)
    s.create(spark.createDataFrame(list(first), "k string, a int"), T0)
    for i, batch in enumerate(batches):
        assert apply_batch(s, spark.createDataFrame(batch, STREAM), f"s-{i}", "seq", T1)
    consistent(s)
    return sorted((r["k"], r["a"], r["b"], tuple((r["m"] or {}).items())) for r in s.read().collect())


def test_a_late_row_does_not_win(spark):
    got = streamed(spark, [[("a", 1, "x", None, 10)], [("a", 2, "y", None, 5)], [("a", 1, "x", None, 12)], [("a", 3, "z", None, 11)]])
    assert got == [("a", 1, "x", ())]


@pytest.mark.parametrize("null_desired", ["unmanaged", "value"])
def test_any_split_into_batches_gives_the_same_table(spark, null_desired):
    rnd = random.Random(null_desired)
    rows = [
        (rnd.choice("abc"), rnd.choice([None, 1, 2]), rnd.choice([None, "x", "y"]), rnd.choice([None, {"p": 1}, {"q": 2}]), rnd.randrange(6))
        for _ in range(24)
    ]
    first = [("a", 100), ("z", 9)]
    whole = streamed(spark, [rows], null_desired, first)
    for _ in range(2):
        rnd.shuffle(rows)
        cut = sorted(rnd.sample(range(1, 24), 3))
        parts = [rows[i:j] for i, j in zip([0, *cut], [*cut, 24], strict=True)]
        assert streamed(spark, parts, null_desired, first) == whole
    if null_desired == "unmanaged":
        want = {}
        for k, a, *_, seq in rows:
            if a is not None:
                want[k] = max(want.get(k, (-1, 0)), (seq, a))
        assert {k: a for k, a, *_ in whole if k != "z"} == {k: v[1] for k, v in want.items()} | {
            k: None for k in {r[0] for r in rows} - set(want) - {"a"}
        }


def test_marks_survive_plans_and_refreshes(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k", share=5)
    s.create(spark.createDataFrame([("a", 0), ("b", 0)], "k string, a int"), T0)
    batch = lambda v, seq: spark.createDataFrame([("a", v, seq)], "k string, a int, seq int")
    apply_batch(s, batch(1, 10), "s-0", "seq", T1)
    s.apply(s.plan(spark.createDataFrame([("a", 2), ("b", 3)], "k string, a int")), T1)
    assert content(s, "a") == {"a": (2,), "b": (3,)} and "__marks" not in s.read().columns
    apply_batch(s, batch(7, 9), "s-1", "seq", T1)
    assert content(s, "a")["a"] == (2,)
    version, changed = s.refresh(spark.createDataFrame([("a", 4), ("b", 3)], "k string, a int"), T1)
    assert changed and content(s, "a")["a"] == (4,)
    apply_batch(s, batch(8, 9), "s-2", "seq", T1)
    apply_batch(s, batch(9, 11), "s-3", "seq", T1)
    assert content(s, "a")["a"] == (9,)
    s.apply(s.plan(s.read().select("k", "a").withColumn("new", F.lit(1))), T1)
    apply_batch(s, batch(10, 10), "s-4", "seq", T1)
    assert content(s, "a", "new") == {"a": (9, 1), "b": (3, 1)}
    consistent(s)


def test_rows_without_an_order_or_a_key_are_refused(spark):
    s = TableStore(spark, scratch_path(spark, "test-store"), "k")
    s.create(spark.createDataFrame([("a", 0)], "k string, a int"), T0)
    for bad in (("a", 1, None), (None, 1, 1)):
        with pytest.raises(Exception, match="has no seq|key is null"):
            s.upsert(spark.createDataFrame([bad], "k string, a int, seq int"), "seq")
    assert s.require().seq == 0


def one_key_per_part(s, n):
    """Keys of ``n`` different parts."""
    at = s.require()
    rows = s.read().select("k", s._part(at.modulus, at.split).alias("p")).collect()
    found = {}
    for r in rows:
        found.setdefault(r["p"], r["k"])
    return list(found.values())[:n]


@pytest.mark.parametrize("turned", [False, True])
def test_two_writers_on_different_parts_both_land(spark, turned):
    s = numbers(spark, 200)
    a, b = one_key_per_part(s, 2)
    one, two = (s.plan(rows_of(spark, s, (k, -k - 1)), deletes=False) for k in (a, b))
    for made in (two, one) if turned else (one, two):
        s.apply(made, T1, rebase=True)
    assert (content(s)[a], content(s)[b]) == ((-a - 1,), (-b - 1,))
    assert (s.require().serial, s.require().seq) == (2, 2)
    consistent(s)


@pytest.mark.parametrize("turned", [False, True])
def test_of_two_writers_on_one_part_the_second_is_refused(spark, turned):
    s = numbers(spark, 200)
    (a,) = one_key_per_part(s, 1)
    one, two = (s.plan(rows_of(spark, s, (a, v)), deletes=False) for v in (-1, -2))
    first, second = (two, one) if turned else (one, two)
    s.apply(first, T1, rebase=True)
    with pytest.raises(StalePlanError):
        s.apply(second, T1, rebase=True)
    assert content(s)[a] == ((-2,) if turned else (-1,))


def test_a_plan_that_others_overtook_is_refused_unless_rebased(spark):
    s = numbers(spark, 200)
    a, b = one_key_per_part(s, 2)
    one, two = (s.plan(rows_of(spark, s, (k, -1)), deletes=False) for k in (a, b))
    s.apply(one, T1)
    with pytest.raises(StalePlanError, match="serial changed"):
        s.apply(two, T1)


def test_writers_that_race_for_one_entry(spark, monkeypatch):
    """The other writer lands between this one's check and its commit."""
    s = numbers(spark, 200)
    other = TableStore(spark, s.path, "k")
    a, b = one_key_per_part(s, 2)
    for key, fits in ((b, True), (a, False)):
        at = s.require()
        made = s.plan(rows_of(spark, s, (a, at.serial - 100)), deletes=False)
        rival = other.plan(rows_of(spark, s, (key, at.serial - 500)), deletes=False)
        add = s.log.add

        def late(version, add=add, rival=rival):
            monkeypatch.setattr(s.log, "add", add)
            other.apply(rival, T1)
            return add(version)

        monkeypatch.setattr(s.log, "add", late)
        if fits:
            s.apply(made, T1, rebase=True)
            assert content(s)[a] == (at.serial - 100,) and content(s)[b] == (at.serial - 500,)
        else:
            with pytest.raises(StalePlanError):
                s.apply(made, T1, rebase=True)
            assert content(s)[a] == (at.serial - 500,)
        consistent(s)


def test_many_versions_open_in_few_reads(spark, monkeypatch):
    s = numbers(spark, 20)
    at = s.require()
    for i in range(2 * WHOLE_EVERY + 5):
        at = s._note(at, f"n-{i}")
    reads = []
    plain = s.log._read
    monkeypatch.setattr(s.log, "_read", lambda seq: reads.append(seq) or plain(seq))
    assert s.require() == at and len(reads) <= WHOLE_EVERY
    assert at.streams == {"n": 2 * WHOLE_EVERY + 4} and s.done("n-3") and not s.done("n-999")
    assert s.versions().count() == at.seq + 1 and content(s)[3] == (30,)
    assert s.version(3).parts == at.parts


def test_a_sweep_removes_what_no_kept_version_names(spark):
    s = numbers(spark, 60, share=0.4)
    for n in range(5):
        s.apply(s.plan(rows_of(spark, s, *[(k, -n) for k in range(n, 60, 7)]), deletes=False), T1)
    kept = [s.version(q) for q in (4, 5)]
    views = [sorted(map(tuple, s.read(v).collect())) for v in kept]
    assert s.sweep(keep=2) == []
    gone = s.sweep(keep=2, grace_seconds=-1)
    named = {os.path.join(*p.split("/")[-2:]) for v in kept for x in v.parts for p in [x["path"], *x["deltas"]] if p}
    data = f"{s.path}/data".removeprefix("file:")
    left = {os.path.join(d, n) for d in os.listdir(data) for n in os.listdir(os.path.join(data, d)) if n.startswith("__part=")}
    assert gone and left == named
    assert [sorted(map(tuple, s.read(v).collect())) for v in kept] == views
    assert s.sweep(keep=2, grace_seconds=-1) == []
    with pytest.raises(ValueError):
        s.sweep(keep=0)


def test_a_sweep_removes_old_log_entries(spark):
    s = numbers(spark, 5)
    at = s.require()
    for i in range(WHOLE_EVERY + 3):
        at = s._note(at, f"n-{i}")
    s.sweep(keep=1, grace_seconds=-1)
    assert s.log.seqs()[0] == WHOLE_EVERY and s.require() == at
    with pytest.raises(ReconError, match="not kept"):
        s.version(1)


def test_drift_reads_only_parts_that_differ(spark):
    s = numbers(spark, 500)
    live = s.read().drop(*TIMESTAMPS)
    same = s.drift(live)
    assert same.count() == 0 and "parquet" not in same._jdf.queryExecution().executedPlan().toString().lower()
    (a,) = one_key_per_part(s, 1)
    moved = live.withColumn("v", F.when(F.col("k") == a, -1).otherwise(F.col("v"))).select("v", "k")
    assert len(s.differing_parts(moved)) == 1
    more = moved.unionByName(rows_of(spark, s, (9_999, 1))).filter("k <> 77")
    for view in (moved, more, live.drop("v"), live.withColumn("extra", F.lit(1))):
        got = sorted(map(str, s.drift(view).collect()))
        own = view if "v" in view.columns else view.withColumn("v", F.lit(None).cast("long"))
        assert got == sorted(map(str, drift(s.read(), own, "k").collect())) and got
    version, changed = s.refresh(more, T1)
    assert changed and 77 not in content(s) and content(s)[a] == (-1,) and 9_999 not in content(s)
    consistent(s)
