"""What must hold beyond small data: plans, skew, and what the code never does."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from tablerecon.operators.checks import check_reference, check_unique_in_group
from tablerecon.operators.lookups import layered_merge, left_enrich, lookup_first, lookup_last, overlay, resolve_aliases, resolve_refs
from tablerecon.operators.skew import hot_keys, salted_join, sketched_join
from tablerecon.plans import plan, snapshot_of, summary
from tablerecon.session import RUNTIME_CONF, configure, scratch_path, shared_dir
from tablerecon.sources import write_table

ROOT = pathlib.Path(__file__).parent.parent


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_limits(spark):
    """Limits so low that a few thousand rows behave like a hot partition."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8kb",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=60000):
    """Two thirds spread over many keys, one third on one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 4001).cast("string")))
    return spark.range(0, n, 1, 8).select("id", key.alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def largest_task(df, *cols):
    """Rows of the fullest partition; using ``cols`` keeps them from being pruned."""
    used = [F.max(c) for c in cols]
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *used)
    return max(r["n"] for r in sizes.collect())


def test_hot_key_of_a_lookup_is_spread(spark, small_limits):
    left = hot_rows(spark)
    right = left.groupBy("name").agg(F.count("*").alias("score"))
    joined = left_enrich(left, right, "name").select("id", "name", "score", "pad")
    assert joined.count() == 60000 and joined.filter("score IS NULL").count() == 0
    assert largest_task(joined, "score", "pad") < 15000
    assert largest_task(left.join(right, "name", "left"), "score", "pad") > 20000


def test_hot_reference_is_spread_and_whole(spark, small_limits):
    left = hot_rows(spark)
    known = left.filter("name <> 'hot'").select("name").distinct()
    found = check_reference(left, "name", known, "name", ["id", "pad"])
    assert found.count() == 20000
    assert largest_task(found, "message", "key") < 10000


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_adaptive_execution_can_split_a_salted_join(spark, small_limits, how):
    left = hot_rows(spark)
    right = left.groupBy(F.col("name").alias("n")).agg(F.count("*").alias("score"))
    plain = left.join(right, F.col("name") == F.col("n"), how)
    assert "skew=true" not in final_plan(plain)
    assert "skew=true" in final_plan(salted_join(left, right, [("name", "n")], how))


def test_hot_key_is_spread_without_adaptive_help(spark, small_limits):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = hot_rows(spark)
        right = left.groupBy(F.col("name").alias("n")).agg(F.count("*").alias("rows"))
        joined = salted_join(left, right, [("name", "n")], "left")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        hot = joined.filter("name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 60000
    assert len(hot) >= 3 and max(r["count"] for r in hot) < 20000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, rows, how):
    left = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(40)], "id int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k2 string, v int")
    for null_safe, salts in [(False, 1), (True, 1), (False, 5), (True, 5)]:
        cond = left["k"].eqNullSafe(right["k2"]) if null_safe else left["k"] == right["k2"]
        salted = salted_join(left, right, [("k", "k2")], how, null_safe, salts)
        assert rows(salted) == rows(left.join(right, cond, how))
    with pytest.raises(ValueError, match="cannot salt"):
        salted_join(left, right, [("k", "k2")], "full_outer")


def test_sketch_names_every_hot_key(spark, small_limits):
    counts = {"a": 9000, "b": 4000, None: 3000, "d": 900}
    rows = [(k,) for k, n in counts.items() for _ in range(n)] + [(f"k{i}",) for i in range(3100)]
    df = spark.createDataFrame(rows, "k string").repartition(7)
    names = {r["h"]: r["k"] for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    found = {names[h]: share for h, share in hot_keys(df, ["k"]).items()}
    assert set(found) == {"a", "b", None}  # above one eighth of 20,000 rows
    assert all(abs(found[k] - counts[k] / 20000) < 0.03 for k in found)
    assert hot_keys(spark.createDataFrame([], "k string"), ["k"]) == {}
    assert hot_keys(spark.range(5000).withColumn("k", F.lit("one")), ["k", "id"]) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sketched_join_equals_the_plain_one(spark, small_limits, rows, how, adaptive):
    left = spark.createDataFrame(
        [(i, i % 3, "ab"[i % 2] if i % 5 else None, f"k{i}") for i in range(400)], "id int, n int, k string, own string"
    )
    right = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 2), ("b", 0, 6), ("c", 3, 3), (None, 2, 4), ("k7", 1, 5)], "k2 string, n2 int, v int"
    )
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for on in ([("k", "k2")], [("own", "k2")], [("k", "k2"), ("n", "n2")]):
            for null_safe in (False, True):
                conds = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
                cond = conds[0] if len(conds) == 1 else conds[0] & conds[1]
                want = rows(left.join(right, cond, how))
                assert rows(sketched_join(left, right, on, how, null_safe)) == want
        wide = right.withColumn("n2", F.col("n2").cast("long"))  # other types: salted as before
        assert rows(sketched_join(left, wide, [("n", "n2")], how)) == rows(left.join(wide, left["n"] == wide["n2"], how))
        assert rows(sketched_join(left.limit(0), right, [("k", "k2")], how)) == []
        assert rows(sketched_join(left, right.limit(0), [("k", "k2")], how)) == rows(left.join(right.limit(0), F.col("k") == F.col("k2"), how))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with pytest.raises(ValueError, match="cannot salt"):
        sketched_join(left, right, [("k", "k2")], "full_outer")


def test_sketch_spreads_the_hot_key_without_adaptive_help(spark, small_limits):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = hot_rows(spark)
        right = left.groupBy(F.col("name").alias("n")).agg(F.count("*").alias("rows"))
        joined = sketched_join(left, right, [("name", "n")], "left")
        hot = joined.filter("name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        salts = {r["n"] for r in right.join(joined, "n").select("n").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(salts) == right.count() and joined.count() == 60000
    assert len(hot) >= 3 and sum(r["count"] for r in hot) == 20000 and max(r["count"] for r in hot) < 10000


def test_bucketed_lookup_keeps_its_layout(spark, small_limits):
    df = spark.range(4000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    hot = df.union(spark.range(4000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    for name, rows in (("b_refs", df), ("b_hot", hot), ("b_side", df)):
        write_table(rows, name, path=scratch_path(spark, name), bucket_by=["k"], buckets=4)
    side = spark.table("b_side").groupBy("k").agg(F.sum("v").alias("s"))
    even = left_enrich(spark.table("b_refs"), side, "k", join=sketched_join)
    assert "Exchange" not in executed(even) and even.filter("s = v").count() == 4000
    assert "Exchange" in executed(left_enrich(spark.table("b_refs"), side, "k"))
    # with a hot key only its rows are dealt anew
    text = executed(left_enrich(spark.table("b_hot"), side, "k", join=sketched_join))
    plain, spread = text.split("SortMergeJoin")[1:]
    assert "Exchange" not in plain.split("Project [k")[0] and "Exchange hashpartitioning" in spread


def test_lookups_agree_whichever_way_they_join(spark, small_limits, rows):
    refs = spark.createDataFrame([(i, "hot" if i % 2 else f"n{i % 40}") for i in range(600)], "id int, name string")
    view = spark.createDataFrame([(f"n{i % 30}", i, i * 3) for i in range(90)] + [("hot", 99, 1)], "name string, pos int, v int")
    nodes = spark.createDataFrame(
        [(f"a{i}", "t", "hot" if i == 3 else f"n{i}", ["a1"]) for i in range(30)],
        "address string, resource_type string, name string, depends_on array<string>",
    )
    wanted = refs.select(
        F.concat(F.lit("a"), F.col("id") % 30).alias("address"), F.col("name").alias("ref_name"),
        F.lit(None).cast("string").alias("ref_type"), F.col("id").alias("position"),
    )
    lists = refs.groupBy((F.col("id") % 20).alias("row")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    names = view.select("name", F.concat(F.lit("to-"), "name").alias("target"))
    scopes = [view.select("name", F.col("v").cast("string").alias("value"), F.col("pos").alias("position")) for _ in range(2)]
    ways = {
        "left_enrich": lambda j: left_enrich(refs, view.select("name", "v"), "name", join=j),
        "lookup_first": lambda j: lookup_first(refs, overlay(view, view, "name", "pos"), "name", "v", join=j),
        "lookup_last": lambda j: lookup_last(refs, view, "name", "v", "pos", join=j),
        "resolve_refs": lambda j: resolve_refs(nodes, wanted, join=j),
        "resolve_aliases": lambda j: resolve_aliases(lists, ["names"], names, inline_limit=0, join=j),
        "layered_merge": lambda j: layered_merge(scopes, join=j),
    }
    for name, run in ways.items():
        assert rows(run(sketched_join)) == rows(run(salted_join)), name


def test_hot_group_names_its_first_holder(spark, small_limits):
    df = hot_rows(spark).withColumn("ns", F.lit("one"))
    found = check_unique_in_group(df, "ns", "name", "pad", "id")
    groups = df.select("name").distinct().count()
    assert found.count() == 60000 - groups
    assert "Window" not in executed(found)


def test_bucketed_tables_meet_without_a_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    for name in ("b_want", "b_have"):
        write_table(df, name, path=scratch_path(spark, name), bucket_by=["k"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = executed(plan(spark.table("b_want"), spark.table("b_have"), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "FullOuter" in text


def test_plan_reads_what_it_compares(spark):
    path = scratch_path(spark, "wide")
    spark.range(10).select(
        F.col("id").alias("k"), F.col("id").alias("v"), F.lit("big").alias("payload")
    ).write.parquet(path)
    want = spark.read.parquet(path).select("k", "v")
    counts = summary(plan(want, spark.read.parquet(path), "k"))
    text = executed(counts)
    assert text.count("ReadSchema: struct<k:bigint,v:bigint>") == 2 and "payload" not in text


def test_one_pass_snapshot_has_one_join(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
    text = executed(snapshot_of(plan(df, df, "k"), "k", df.schema))
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", text)) == 1


def test_session_settings(spark):
    configure(spark)
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())


class FakeSession:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, **conf):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder_is_the_cluster_s(spark):
    named = FakeSession("yarn", **{"spark.checkpoint.dir": "/shared/ck/"})
    assert shared_dir(named) == "/shared/ck"
    assert scratch_path(named, "x").startswith("/shared/ck/tablerecon/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    assert shared_dir(spark)


def test_code_keeps_to_the_cluster():
    """No lineage kept on executors only, no cross joins, no forced broadcasts, no row UDFs."""
    banned = ["local" + "Checkpoint", "cross" + "Join", "broad" + "cast(", ".to" + "Pandas", "F." + "udf(", ".rdd"]
    for path in (ROOT / "tablerecon").rglob("*.py"):
        if "llm" in path.parts:
            continue  # has rules of its own
        text = path.read_text()
        assert not [b for b in banned if b in text], path
