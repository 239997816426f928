import pytest
from pyspark.sql import functions as F

from tablerecon.operators.lookups import (
    layered_merge,
    left_enrich,
    lookup_first,
    lookup_last,
    overlay,
    resolve_aliases,
    resolve_refs,
)


def test_left_enrich(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    right = spark.createDataFrame([(1, 0.5, "A"), (None, 0.9, "N")], "id int, risk double, name string")
    got = left_enrich(left, right, "id", fill={"risk": 0.0, "extra": 1})
    assert got.columns == ["id", "name", "risk", "name_ref", "extra"]
    assert rows(got) == sorted([(1, "a", 0.5, "A", 1), (2, "b", 0.0, None, 1), (None, "c", 0.0, None, 1)], key=repr)
    safe = left_enrich(left, right, "id", null_safe=True)
    assert (None, "c", 0.9, "N") in rows(safe)


def test_fill_of_a_clashing_column_takes_the_right_side(spark, rows):
    left = spark.createDataFrame([(1, 7.0), (2, 8.0)], "id int, risk double")
    right = spark.createDataFrame([(1, 0.5)], "id int, risk double")
    got = left_enrich(left, right, "id", fill={"risk": 0.0})
    assert got.columns == ["id", "risk", "risk_ref"]
    assert rows(got) == [(1, 0.5, 0.5), (2, 0.0, None)]


def test_resolve_refs(spark, rows):
    nodes = spark.createDataFrame(
        [
            ("ds.a", "ds", "a", []),
            ("zone.a", "zone", "a", []),
            ("rec.r", "rec", "r", ["zone.z", "ds.a"]),
            ("rec.a", "rec", "a", []),
        ],
        "address string, resource_type string, name string, depends_on array<string>",
    )
    refs = spark.createDataFrame(
        [("rec.r", "a", None, 0), ("rec.r", "a", "zone", 1), ("rec.a", "a", "rec", 0), ("rec.a", "gone", None, 1)],
        "address string, ref_name string, ref_type string, position int",
    )
    got = rows(resolve_refs(nodes, refs), "address", "dep", "explicit")
    assert got == [("rec.r", "ds.a", True), ("rec.r", "rec.a", False), ("rec.r", "zone.a", False), ("rec.r", "zone.z", True)]


def test_overlay_and_lookup_first(spark):
    ddl = "address string, name string, type string, zone string, pos int"
    desired = spark.createDataFrame([("ds.a", "a", "pg_dataset", None, 1), ("f.b", "b", "folder", "z1", 2)], ddl)
    prior = spark.createDataFrame(
        [("ds.a", "a", "pg_dataset", "hidden", 1), ("x.a", "a", "sf_dataset", "z9", 2), ("ds.b", "b", "pg_dataset", "z2", 3)], ddl
    )
    view = overlay(desired, prior, "address", "pos")
    assert sorted(r["address"] for r in view.collect()) == ["ds.a", "ds.b", "f.b", "x.a"]
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = {r["name"]: r["zone"] for r in lookup_first(refs, view, "name", "zone").collect()}
    assert got == {"a": None, "b": "z1", "c": None}
    typed = lookup_first(refs, view, "name", "zone", type_col="type", type_suffix="_dataset")
    assert {r["name"]: r["zone"] for r in typed.collect()} == {"a": None, "b": "z2", "c": None}
    exact = lookup_first(refs, view, "name", "zone", type_col="type", type_is="sf_dataset")
    assert {r["name"]: r["zone"] for r in exact.collect()} == {"a": "z9", "b": None, "c": None}


def test_overlay_ranks_the_last_declared_first(spark):
    desired = spark.createDataFrame([("x.n", "n", "first", 1), ("y.n", "n", "second", 2)], "address string, name string, v string, pos int")
    view = overlay(desired, desired.filter(F.lit(False)), "address", "pos")
    refs = spark.createDataFrame([("n",)], "name string")
    assert lookup_first(refs, view, "name", "v").first()["v"] == "second"


def test_lookup_last(spark):
    table = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", None, 1)], "name string, id string, pos int")
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = {r["name"]: r["id"] for r in lookup_last(refs, table, "name", "id", "pos").collect()}
    assert got == {"a": "2", "b": None, "c": None}


@pytest.mark.parametrize("inline_limit", [0, 256])
def test_resolve_aliases(spark, inline_limit):
    df = spark.createDataFrame(
        [
            (1, ["x", "shared", "shared"], ["y"]),
            (2, [], None),
            (3, None, ["shared", None]),
            (None, ["shared"], ["both"]),
            (None, ["z"], ["z"]),
        ],
        "id int, inputs array<string>, outputs array<string>",
    )
    aliases = spark.createDataFrame(
        [("shared", "P.cust"), ("both", "Q.b"), ("both", "P.b"), (None, "P.n"), ("z", None)], "name string, target string"
    )
    out = resolve_aliases(df, ["inputs", "outputs"], aliases, inline_limit=inline_limit)
    got = [(r["id"], r["inputs"], r["outputs"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, ["x", "P.cust", "P.cust"], ["y"]),
            (2, [], None),
            (3, None, ["P.cust", None]),
            (None, ["P.cust"], ["P.b"]),
            (None, ["z"], ["z"]),
        ],
        key=repr,
    )
    assert out.columns == df.columns


def test_layered_merge(spark):
    ddl = "name string, value string, kind string, position int"
    base = spark.createDataFrame([("projectKey", "P", "string", 0), ("b", "0", "string", 1)], ddl)
    standard = spark.createDataFrame([("a", "1", "string", 0), ("b", "2", "string", 1)], ddl)
    local = spark.createDataFrame([("b", "7", "number", 0), ("a", "3", "string", 1), ("c", None, "null", 2)], ddl)
    out = layered_merge([base, standard, local], kind="kind").orderBy("position")
    assert [(r["name"], r["value"]) for r in out.collect()] == [("projectKey", "P"), ("b", "2"), ("a", "3")]


def test_lookups_do_not_sort_their_input(spark):
    """Positions are found by numeric minima: the plans hold no SortAggregate."""
    from tablerecon.operators.checks import check_unique_in_group

    rows = spark.createDataFrame([("a", "x", 1, "d"), ("a", "y", 1, "d")], "name string, value string, pos int, type string")
    view = overlay(rows, rows.filter("pos > 5"), "name", "pos")
    refs = rows.select("name")
    plans = [
        lookup_first(refs, view, "name", "value"),
        lookup_last(refs, rows, "name", "value", "pos"),
        layered_merge([rows.withColumnRenamed("pos", "position"), rows.withColumnRenamed("pos", "position")]),
        check_unique_in_group(rows, "type", "name", "value", "pos"),
    ]
    for df in plans:
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_ties_and_nulls_have_one_result(spark):
    rows = spark.createDataFrame(
        [("a", "y", 1), ("a", "x", 1), ("a", "z", 0), ("b", None, 2), ("b", "q", 1), ("c", "p", None)],
        "name string, value string, pos int",
    )
    refs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    last = {r["name"]: r["value"] for r in lookup_last(refs, rows, "name", "value", "pos").collect()}
    assert last == {"a": "x", "b": None, "c": "p", "d": None}
    scopes = [rows.withColumnRenamed("pos", "position")] * 2
    got = {r["name"]: (r["value"], r["position"]["scope"], r["position"]["position"]) for r in layered_merge(scopes).collect()}
    assert got == {"a": ("x", 0, 0), "b": ("q", 0, 1), "c": ("p", 0, None)}
