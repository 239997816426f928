import pytest
from pyspark.sql import functions as F

from tablerecon.errors import EmptyTableError, ValidationError
from tablerecon.operators import checks as C
from tablerecon.operators.quality import assert_not_empty, not_empty_report, qa_frame, qa_sql


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_pattern(spark):
    df = spark.createDataFrame([(1, "ok_1"), (2, "no-dash"), (3, None), (4, "")], "id int, name string")
    assert keys(C.check_pattern(df, "name", C.NAME_PATTERN, "id")) == ["2", "4"]
    colors = spark.createDataFrame([(1, "#2ab1ac"), (2, "#2ab1a"), (3, "red")], "id int, color string")
    assert keys(C.check_pattern(colors, "color", C.COLOR_PATTERN, "id")) == ["2", "3"]


def test_non_empty(spark):
    df = spark.createDataFrame([(1, "x", ["a"]), (2, "", []), (3, None, ["a", ""]), (4, "x", [None])],
                               "id int, name string, tags array<string>")
    assert keys(C.check_non_empty(df, "name", "id")) == ["2", "3"]
    assert keys(C.check_non_empty(df, "tags", "id")) == ["2", "3", "4"]


def test_in_set_and_implies(spark):
    df = spark.createDataFrame(
        [(1, "table", "t", None), (2, "table", None, "q"), (3, "query", None, "q"), (4, "view", "t", "q")],
        "id int, mode string, table string, query string",
    )
    assert keys(C.check_in_set(df, "mode", ["table", "query"], "id")) == ["4"]
    assert keys(C.check_implies(df, F.col("mode") == "table", F.col("table").isNotNull(), "id", "needs table")) == ["2"]
    flags = {"one": C.exactly_one("table", "query"), "most one": C.exclusive("table", "query")}
    got = sorted((r["key"], r["message"]) for r in C.check_flags(df, flags, "id").collect())
    assert got == [("4", "most one"), ("4", "one")]


def test_unique_and_first_holder(spark):
    df = spark.createDataFrame(
        [("ds", "a", "x.a", 1), ("ds", "a", "y.a", 2), ("ds", "a", "z.a", 3), ("zone", "a", "q.a", 0)],
        "ns string, name string, address string, pos int",
    )
    assert keys(C.check_unique(df, ["ns", "name"])) == ["ds|a"]
    got = sorted((r["key"], r["message"]) for r in C.check_unique_in_group(df, "ns", "name", "address", "pos").collect())
    assert [k for k, _ in got] == ["y.a", "z.a"]
    assert all("first held by x.a" in m and "duplicate ds name 'a'" in m for _, m in got)


def test_references(spark):
    df = spark.createDataFrame([("a", ["b", "gone"], "z"), ("b", [], None)], "id string, deps array<string>, zone string")
    state = spark.createDataFrame([("z", "zone"), ("d", "pg_dataset")], "id string, type string")
    found = C.check_reference(df, "deps", [df, state], "id", "id").collect()
    assert [(r["key"], r["message"]) for r in found] == [("a", "unknown reference: gone")]
    assert keys(C.check_typed_reference(df, "zone", state, "id", "type", "id", type_is="zone")) == []
    assert keys(C.check_typed_reference(df, "zone", state, "id", "type", "id", type_suffix="_dataset")) == ["a"]


def test_any_member(spark):
    members = spark.createDataFrame([("r1", True), ("r1", None), ("r2", False), ("r3", None)], "r string, ok boolean")
    owners = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "r string")
    assert keys(C.check_any_member(members, "r", F.col("ok"), "m")) == ["r2", "r3"]
    assert keys(C.check_any_member(members, "r", F.col("ok"), "m", owners=owners)) == ["r2", "r3", "r4"]


def test_sql_inputs(spark):
    """One SQL-capable input is enough."""
    inputs = spark.createDataFrame(
        [("r1", "a", "Filesystem", False), ("r1", "b", "Snowflake", False), ("r2", "a", "Filesystem", False),
         ("r3", "f", None, True), ("r4", "OTHER.x", None, None), ("r5", "gone", None, None)],
        "r string, ref string, type string, is_foreign boolean",
    )
    ok = C.sql_capable(F.col("ref"), F.col("type"), F.col("is_foreign"))
    assert keys(C.check_any_member(inputs, "r", ok, "no SQL input")) == ["r2", "r5"]


def test_functional_dependency_and_self(spark):
    df = spark.createDataFrame([("a", "P.x"), ("a", "P.x"), ("b", "P.y"), ("b", "Q.y"), ("c", None)], "k string, v string")
    found = C.check_functional_dependency(df, "k", "v").collect()
    assert [(r["key"], r["message"]) for r in found] == [("b", "conflicting values: P.y vs Q.y")]
    own = spark.createDataFrame([("P", ["P", "Q"]), ("P", ["Q"]), ("P", None)], "own string, targets array<string>")
    assert keys(C.check_not_self(own, "own", "targets", "own")) == ["P"]


def test_granted(spark):
    refs = spark.createDataFrame([("DATASET", "a", "ME"), ("DATASET", "b", "ME"), ("FOLDER", "a", "ME"), ("DATASET", "c", "ME")],
                                 "type string, name string, target string")
    objects = spark.createDataFrame([("DATASET", "a"), ("DATASET", "b"), ("FOLDER", "a")], "type string, name string")
    rules = spark.createDataFrame(
        [("DATASET", "a", "ME"), ("DATASET", "a", "ME"), ("DATASET", "b", "YOU"), ("DATASET", "c", "ME")],
        "type string, name string, target string",
    )
    got = keys(C.check_granted(refs, objects, rules, ["type", "name"], ["type", "name"], "target"))
    assert got == ["DATASET|b", "DATASET|c", "FOLDER|a"]


def test_registry(spark):
    df = spark.createDataFrame([(1, "py39"), (2, "r40"), (3, None)], "id int, env string")
    envs = spark.createDataFrame([("py39", "PYTHON"), ("r40", "R")], "name string, lang string")
    assert keys(C.check_in_registry(df, "env", envs, "name", "lang", "PYTHON", "id")) == ["2"]


def test_all_violations_are_reported_together(spark):
    df = spark.createDataFrame([(i, "") for i in range(30)], "id int, name string")
    found = C.violations(C.check_non_empty(df, "name", "id"), C.check_unique(df, "name"))
    with pytest.raises(ValidationError) as e:
        C.assert_valid(found)
    assert len(e.value.messages) == 20 and str(e.value).endswith("...")
    C.assert_valid(found.filter(F.lit(False)))


def test_quality(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    none = df.filter(F.lit(False))
    assert tuple(qa_sql(df, ["x", "y"]).first()) == (2, 1, 2)
    assert tuple(qa_sql(none, ["x"]).first()) == (0, None)
    assert qa_sql(df, ["x"], stamp="checked_at").columns == ["checked_at", "total_rows", "missing_x"]
    assert tuple(qa_frame(df, ["x"]).first()) == (2, 1)
    assert qa_frame(none, ["x"]).count() == 0
    assert assert_not_empty(df) is df
    with pytest.raises(EmptyTableError, match="published is empty"):
        assert_not_empty(none, "published")
    assert {tuple(r) for r in not_empty_report(a=df, b=none).collect()} == {("a", True), ("b", False)}
