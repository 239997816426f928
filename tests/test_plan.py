"""Plan, drift, refresh, apply: cases, and invariants on random tables."""

import datetime as dt
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablerecon.errors import DuplicateKeyError, ValidationError
from tablerecon.operators.checks import assert_valid
from tablerecon.plans import (
    apply_changes,
    check_plan,
    diff_fields,
    drift,
    next_serial,
    plan,
    plan_destroy,
    refresh,
    snapshot_of,
    summary,
    summary_actionable,
)
from tablerecon.plans.apply import check_declared_keys, with_timestamps
from tablerecon.plans.changes import plan_upserts

RECORD = (
    "address string, name string, description string, tags array<string>, value int, "
    "config map<string,string>, items array<int>"
)
STRATEGIES = {"tags": "set", "config": "partial"}
T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 6, 1)


def record(key, **over):
    base = {"name": key, "description": "", "tags": [], "value": 0, "config": {}, "items": []}
    base.update(over)
    return (key, *base.values())


def frame(spark, *records):
    return spark.createDataFrame(list(records), RECORD)


def actions(changes):
    return {r["address"]: r["action"] for r in changes.select("address", "action").collect()}


def test_actions(spark):
    prior = frame(spark, record("a"), record("b", value=1), record("c"))
    desired = frame(spark, record("a"), record("b", value=2), record("d"))
    changes = plan(desired, prior, "address", STRATEGIES)
    assert actions(changes) == {"a": "no-op", "b": "update", "c": "delete", "d": "create"}
    by = {r["address"]: r for r in changes.collect()}
    assert by["b"]["changed_fields"] == ["value"]
    assert (by["b"]["prior"]["value"], by["b"]["planned"]["value"]) == (1, 2)
    assert by["d"]["prior"] is None and by["c"]["desired"] is None and by["c"]["planned"] is None
    assert by["c"]["changed_fields"] == by["d"]["changed_fields"] == []


def test_strategies_per_column(spark):
    prior = frame(spark, record("a", tags=["x", "y"], config={"k": "1", "z": "9"}, items=[1, 2]))
    same = frame(spark, record("a", tags=["y", "x", "x"], config={"k": "1"}, items=[1, 2]))
    assert actions(plan(same, prior, "address", STRATEGIES)) == {"a": "no-op"}
    assert actions(plan(same, prior, "address", {**STRATEGIES, "config": "exact"})) == {"a": "update"}
    order = frame(spark, record("a", tags=["x", "y"], config={}, items=[2, 1]))
    assert actions(plan(order, prior, "address", STRATEGIES)) == {"a": "update"}


def test_null_desired(spark):
    prior = frame(spark, record("a", value=5))
    desired = frame(spark, record("a", value=None))
    assert actions(plan(desired, prior, "address")) == {"a": "no-op"}
    assert actions(plan(desired, prior, "address", null_desired="value")) == {"a": "update"}
    with pytest.raises(ValueError, match="null_desired"):
        plan(desired, prior, "address", null_desired="other")


def test_columns_on_one_side_only(spark):
    prior = spark.createDataFrame([("a", 1, "kept")], "k string, v int, extra string")
    desired = spark.createDataFrame([("a", 1, "new")], "k string, v int, fresh string")
    changes = plan(desired, prior, "k")
    row = changes.first()
    assert (row["action"], row["changed_fields"]) == ("update", ["fresh"])
    assert [tuple(r) for r in diff_fields(changes, "k").collect()] == [("a", "fresh", None, "new")]
    after = apply_changes(prior, changes, "k")
    assert [r.asDict() for r in after.collect()] == [{"k": "a", "v": 1, "extra": "kept", "fresh": "new"}]


def test_composite_and_null_keys(spark):
    ddl = "a int, b string, v int"
    desired = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], ddl)
    prior = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], ddl)
    got = sorted((r["a"], r["b"], r["action"]) for r in plan(desired, prior, ["a", "b"]).collect())
    assert got == [(1, "x", "no-op"), (1, "y", "create"), (2, "y", "delete")]
    half = desired.unionByName(spark.createDataFrame([(None, "x", 3)], ddl))
    with pytest.raises(Exception, match="key is null"):
        plan(half, prior, ["a", "b"]).collect()


def test_tables_of_nothing_but_keys(spark):
    one, two = (spark.createDataFrame(x, "k int") for x in ([(1,), (2,)], [(2,), (3,)]))
    changes = plan(two, one, "k")
    assert {r["k"]: r["action"] for r in changes.collect()} == {1: "delete", 2: "no-op", 3: "create"}
    assert sorted(r["k"] for r in apply_changes(one, changes, "k").collect()) == [2, 3]
    assert sorted(r["k"] for r in snapshot_of(changes, "k", one.schema).collect()) == [2, 3]
    assert [(r["k"], r["action"]) for r in drift(one, two, "k").collect()] == [(1, "delete")]
    assert plan_destroy(one, "k").count() == 2
    assert diff_fields(changes, "k").count() == 0


def test_duplicate_keys_are_refused(spark):
    twice = frame(spark, record("a"), record("a", value=1))
    one = frame(spark, record("a"))
    with pytest.raises(DuplicateKeyError, match="desired"):
        plan(twice, one, "address", check_keys=True)
    with pytest.raises(DuplicateKeyError, match="prior"):
        plan(one, twice, "address", check_keys=True)


def test_ignored_column_is_carried(spark):
    ddl = "k string, v int, depends_on array<string>"
    prior = spark.createDataFrame([("a", 1, ["x"]), ("b", 1, ["x"])], ddl)
    desired = spark.createDataFrame([("a", 1, ["y"]), ("b", 2, ["y"])], ddl)
    changes = plan(desired, prior, "k", ignore=["depends_on"])
    assert {r["k"]: r["action"] for r in changes.collect()} == {"a": "no-op", "b": "update"}
    after = {r["k"]: r["depends_on"] for r in apply_changes(prior, changes, "k").collect()}
    assert after == {"a": ["x"], "b": ["y"]}


def test_variables_resolve_before_comparing(spark):
    prior = frame(spark, record("a", description="PRJ/raw", config={"p": "PRJ"}))
    desired = frame(spark, record("a", description="${key}/raw", config={"p": "${key}"}))
    assert actions(plan(desired, prior, "address")) == {"a": "update"}
    changes = plan(desired, prior, "address", variables={"key": "PRJ"})
    row = changes.first()
    assert row["action"] == "no-op"
    assert (row["desired"]["description"], row["planned"]["description"]) == ("${key}/raw", "PRJ/raw")


def test_declared_defaults_expanded_by_the_store(spark):
    """A declared subset of parameters stays a no-op when the store adds its defaults."""
    ddl = "k string, params map<string,string>"
    declared = {"quoteChar": '"', "charset": "UTF-8"}
    expanded = {**declared, "separator": ";", "compress": "", "parseHeaderRow": "true"}
    desired = spark.createDataFrame([("a", declared)], ddl)
    assert plan(desired, spark.createDataFrame([("a", expanded)], ddl), "k").first()["action"] == "no-op"
    drifted = spark.createDataFrame([("a", {**expanded, "quoteChar": "|"})], ddl)
    changes = plan(desired, drifted, "k")
    assert changes.first()["action"] == "update"
    after = apply_changes(drifted, changes, "k").first()["params"]
    assert after == expanded


def test_summaries_are_zero_filled(spark, rows):
    prior = frame(spark, record("a"))
    changes = plan(prior, prior, "address")
    assert rows(summary(changes)) == [("create", 0), ("delete", 0), ("no-op", 1), ("update", 0)]
    assert rows(summary_actionable(changes)) == [("create", 0), ("delete", 0), ("update", 0)]
    none = changes.filter(F.lit(False))
    assert sum(r["rows"] for r in summary(none).collect()) == 0


def test_destroy(spark):
    prior = frame(spark, record("a"), record("b"))
    changes = plan_destroy(prior, "address")
    assert actions(changes) == {"a": "delete", "b": "delete"}
    assert apply_changes(prior, changes, "address").count() == 0


def test_upserts_never_delete(spark):
    prior = frame(spark, record("a"), record("b"))
    desired = frame(spark, record("b", value=1), record("c"))
    assert actions(plan_upserts(desired, prior, "address")) == {"b": "update", "c": "create"}


def test_apply_timestamps(spark):
    prior = with_timestamps(frame(spark, record("a"), record("b"), record("c")), T0)
    desired = frame(spark, record("a"), record("b", value=1), record("d"))
    changes = plan(desired, prior, "address", STRATEGIES)
    for after in (
        apply_changes(prior, changes, "address", T1, STRATEGIES),
        snapshot_of(changes, "address", prior.schema, T1, STRATEGIES),
    ):
        got = {r["address"]: (r["created_at"].month, r["updated_at"].month, r["value"]) for r in after.collect()}
        assert got == {"a": (1, 1, 0), "b": (1, 6, 1), "d": (6, 6, 0)}


def test_next_serial(spark, rows):
    version = spark.createDataFrame([("line", 7)], "lineage string, serial long")
    prior = frame(spark, record("a"), record("b"))
    changes = plan(frame(spark, record("a", value=1), record("c")), prior, "address")
    assert rows(next_serial(version, changes)) == [("line", 10)]
    assert rows(next_serial(version, plan(prior, prior, "address"))) == [("line", 7)]


def test_check_plan(spark):
    prior = frame(spark, record("a"))
    changes = plan(frame(spark, record("b")), prior, "address")
    assert_valid(check_plan(changes, prior, "address"))
    twice = changes.unionByName(changes)
    found = {r["check"] for r in check_plan(twice, prior, "address").collect()}
    assert found == {"plan_unique"}
    empty = prior.filter(F.lit(False))
    assert {r["key"] for r in check_plan(changes, empty, "address").collect()} == {"a"}
    bare = changes.withColumn("desired", F.when(F.lit(False), F.col("desired")))
    assert {r["check"] for r in check_plan(bare, prior, "address").collect()} == {"plan_desired"}
    odd = changes.withColumn("action", F.lit("rename"))
    assert {r["check"] for r in check_plan(odd, prior, "address").collect()} == {"plan_action"}
    with pytest.raises(ValidationError, match="more than|rows: 2"):
        assert_valid(check_plan(twice, prior, "address"))
    other = changes.withColumn("address", F.concat("address", F.lit("x")))
    wrong = check_declared_keys(other, "address", ["name"])
    assert [r["key"] for r in wrong.collect()] == ["bx"]


def test_drift(spark):
    old = frame(spark, record("a"), record("b", value=None), record("c", config={"k": "1"}), record("d"))
    new = frame(
        spark, record("a"), record("b", value=1), record("c", config={"k": "1", "z": "2"}), record("new")
    )
    got = {r["address"]: (r["action"], r["changed_fields"]) for r in drift(old, new, "address").collect()}
    assert got == {"b": ("update", ["value"]), "c": ("update", ["config"]), "d": ("delete", [])}
    assert drift(old, old, "address").count() == 0


def test_drift_over_the_union_of_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "k string, v int, gone string")
    new = spark.createDataFrame([("a", 1, None), ("b", 1, "y")], "k string, v int, fresh string")
    got = {r["k"]: r["changed_fields"] for r in drift(old, new, "k").collect()}
    assert got == {"a": ["gone"], "b": ["fresh"]}


def test_refresh(spark):
    state = with_timestamps(frame(spark, record("a"), record("b"), record("c")), T0)
    live = frame(spark, record("a"), record("b", value=3, name="renamed"), record("new"))
    after = refresh(state, live, "address", T1, flag="hit")
    got = {r["address"]: (r["value"], r["name"], r["updated_at"].month, r["hit"]) for r in after.collect()}
    assert got == {"a": (0, "a", 1, False), "b": (3, "renamed", 6, True)}
    echoed = refresh(state, live, "address", T1, echo=["name", "value"])
    assert {r["address"]: (r["value"], r["updated_at"].month) for r in echoed.collect()} == {"a": (0, 1), "b": (0, 1)}


def test_refresh_rehashes_replaced_rows(spark):
    state = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v int, attributes_hash string")
    live = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int")
    got = {r["k"]: r["attributes_hash"] for r in refresh(state, live, "k", hash_col="attributes_hash").collect()}
    assert got["a"] == "old" and len(got["b"]) == 64


values = st.tuples(
    st.none() | st.integers(0, 2),
    st.none() | st.lists(st.sampled_from("xyz"), max_size=3),
    st.none() | st.dictionaries(st.sampled_from("ab"), st.sampled_from(["1", "2"]), max_size=2),
)
tables = st.dictionaries(st.integers(0, 12), values, max_size=10)
DDL = "k int, v int, tags array<string>, config map<string,string>"


def table(spark, content):
    return spark.createDataFrame([(k, *v) for k, v in content.items()], DDL)


def expected_action(want, have):
    if have is None:
        return "create"
    (v, tags, config), (pv, ptags, pconfig) = want, have
    if v is not None and v != pv:
        return "update"
    if tags is not None and (ptags is None or set(tags) != set(ptags)):
        return "update"
    if config is not None and (pconfig is None or any(pconfig.get(k) != x for k, x in config.items())):
        return "update"
    return "no-op"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(tables, tables)
def test_random_tables(spark, want, have):
    desired, prior = table(spark, want), table(spark, have)
    strategies = {"tags": "set"}
    changes = plan(desired, prior, "k", strategies)
    got = {r["k"]: r["action"] for r in changes.select("k", "action").collect()}
    expected = {k: expected_action(v, have.get(k)) for k, v in want.items()}
    expected.update({k: "delete" for k in have if k not in want})
    assert got == expected
    after = apply_changes(prior, changes, "k", strategies=strategies)
    assert {r["k"] for r in after.collect()} == set(want)
    again = plan(desired, after, "k", strategies)
    assert {r["action"] for r in again.select("action").collect()} <= {"no-op"}
    one_pass = snapshot_of(changes, "k", prior.schema, strategies=strategies)
    assert sorted(map(repr, one_pass.collect())) == sorted(map(repr, after.collect()))
    assert drift(prior, prior, "k").count() == 0


def test_apply_meets_structs_by_name_and_settles(spark):
    """Any nested desired table, applied, plans to nothing but no-ops."""
    rng = random.Random(6)
    new = "k int, s struct<kind: string, deep: struct<b: int, extra: string>>, m map<string, struct<y: int>>, j string"
    old = "k int, s struct<x: string, deep: struct<a: int, b: int>, kind: string>, m map<string, struct<x: int, y: int>>, j string"

    def some(value):
        return None if rng.random() < 0.2 else value

    def document(depth):
        keys = [k for k in "abc" if rng.random() < 0.6]
        return {k: document(depth - 1) if depth and rng.random() < 0.5 else rng.randrange(3) for k in keys}

    word, number = (lambda: some(rng.choice("pq"))), (lambda: some(rng.randrange(3)))
    desired = [
        (k, some((word(), some((number(), word())))), some({x: some((number(),)) for x in "uv" if rng.random() < 0.6}), json.dumps(document(3)))
        for k in range(60)
    ]
    prior = [
        (k, some((word(), some((number(), number())), word())), some({x: some((number(), number())) for x in "vw"}), json.dumps(document(3)))
        for k in range(20, 80)
    ]
    d = spark.createDataFrame(desired, new).withColumn("j", F.parse_json("j"))
    p = spark.createDataFrame(prior, old).withColumn("j", F.parse_json("j"))
    after = apply_changes(p, plan(d, p, "k"), "k", dt.datetime(2024, 1, 1))
    assert [f.name for f in after.schema["s"].dataType.fields] == ["x", "deep", "kind"]
    assert {r["action"] for r in plan(d, after, "k").collect()} == {"no-op"}
    stored = {r["k"]: r for r in after.collect()}
    for k, s, *_ in prior:
        want = dict((x[0], x) for x in desired).get(k)
        if want is not None and s is not None and want[1] is not None:
            assert stored[k]["s"]["x"] == s[0] and stored[k]["s"]["kind"] == want[1][0]


def test_null_keys_fail_when_the_action_is_read(spark):
    one = spark.createDataFrame([(None, 1)], "k string, v int")
    with pytest.raises(Exception, match="key is null"):
        plan(one, one.limit(0), "k").collect()
