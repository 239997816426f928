"""Comparison truth table, and random values against a plain Python rule."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions import differs
from tablerecon.functions.documents import parse

FLAT = "map<string,int>"
NESTED = "map<string,map<string,int>>"
LIST = "array<string>"

CASES = [
    (1, 1, "int", "partial", False),
    (1, 2, "int", "partial", True),
    ({"a": 1}, {"a": 1, "z": 9}, FLAT, "partial", False),
    ({"a": 1}, {"a": 2, "z": 9}, FLAT, "partial", True),
    ({"a": 1, "b": 2}, {"a": 1}, FLAT, "partial", True),
    ({"a": 1, "b": None}, {"a": 1}, FLAT, "partial", False),
    ({}, {"a": 1}, FLAT, "partial", False),
    ({"n": {"a": 1}}, {"n": {"a": 1, "z": 9}}, NESTED, "partial", False),
    ({"n": {"a": 1}}, {"n": {"a": 2, "z": 9}}, NESTED, "partial", True),
    ({"n": {"a": 1}}, {"m": {"a": 1}}, NESTED, "partial", True),
    ({"a": 1}, None, FLAT, "partial", True),
    (None, {"a": 1}, FLAT, "partial", True),
    (None, None, FLAT, "partial", False),
    (["a", "b"], ["b", "a"], LIST, "partial", True),
    (["a", "b"], ["a", "b"], LIST, "partial", False),
    (["a", "b"], ["b", "a"], LIST, "set", False),
    (["a", "b", "a"], ["b", "a"], LIST, "set", False),
    (["a", "b"], ["a", "c"], LIST, "set", True),
    ([], ["a"], LIST, "set", True),
    (None, ["a"], LIST, "set", True),
    (["a", "b"], ["b", "a"], LIST, "exact", True),
    ({"a": 1}, {"a": 1, "z": 9}, FLAT, "exact", True),
    ({"a": 1, "z": 9}, {"z": 9, "a": 1}, FLAT, "exact", False),
    ({"n": {"a": 1, "b": 2}}, {"n": {"b": 2, "a": 1}}, NESTED, "exact", False),
    ({"n": {"a": 1}}, {"n": {"a": 1, "z": 9}}, NESTED, "exact", True),
    ({"a": 1}, {"a": 1, "z": 9}, FLAT, "set", True),
]


@pytest.mark.parametrize(("desired", "prior", "ddl", "strategy", "expected"), CASES)
def test_truth_table(spark, desired, prior, ddl, strategy, expected):
    dtype = T.DataType.fromDDL(ddl)
    schema = T.StructType([T.StructField("d", dtype), T.StructField("p", dtype)])
    df = spark.createDataFrame([(desired, prior)], schema)
    assert df.select(differs(F.col("d"), F.col("p"), dtype, dtype, strategy)).first()[0] is expected


def test_struct_is_partial_and_recursive(spark):
    df = spark.sql(
        """SELECT named_struct('a', 1, 'n', named_struct('x', 1)) AS d,
                  named_struct('a', 1, 'n', named_struct('x', 1, 'y', 2), 'z', 3) AS p"""
    )
    d, p = df.schema["d"].dataType, df.schema["p"].dataType
    out = df.select(
        differs(F.col("d"), F.col("p"), d, p),
        differs(F.col("p"), F.col("d"), p, d),
        differs(F.lit(None).cast(d), F.col("p"), d, p),
    ).first()
    assert tuple(out) == (False, True, True)


def test_unknown_strategy():
    with pytest.raises(ValueError, match="unknown strategy"):
        differs(F.col("a"), F.col("b"), T.IntegerType(), strategy="loose")


def flat(document, at=()):
    """Leaf paths of a document; an empty object is a leaf of its own."""
    if not isinstance(document, dict) or not document:
        return {at: document}
    out = {}
    for k, v in document.items():
        out |= flat(v, (*at, k))
    return out


def at_path(document, path):
    for k in path:
        document = document.get(k) if isinstance(document, dict) else None
    return document


def expected_difference(desired, prior):
    """Each leaf of desired is looked up in prior; an empty object only asks for an object."""
    for path, leaf in flat(desired).items():
        parents = [at_path(prior, path[:n]) for n in range(len(path))]
        if not all(isinstance(p, dict) for p in parents):
            return True
        found = at_path(prior, path)
        if found != leaf and not (leaf == {} and isinstance(found, dict)):
            return True
    return False


leaf = st.none() | st.integers(0, 2) | st.sampled_from(["x", "y"]) | st.lists(st.integers(0, 1), max_size=2)
document = st.recursive(
    st.dictionaries(st.sampled_from("abc"), leaf, max_size=3),
    lambda inner: st.dictionaries(st.sampled_from("abc"), leaf | inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(document, document), min_size=40, max_size=60))
def test_json_documents_like_plain_rule(spark, pairs):
    df = spark.createDataFrame(
        [(i, json.dumps(d), json.dumps(p)) for i, (d, p) in enumerate(pairs)], "i int, d string, p string"
    )
    flag = differs(parse(F.col("d")), parse(F.col("p")), T.VariantType(), T.VariantType())
    got = dict(df.select("i", flag).collect())
    for i, (d, p) in enumerate(pairs):
        assert got[i] is expected_difference(d, p), (d, p)


def _deep(depth, leaf):
    return '{"a":' * depth + leaf + "}" * depth


def _json_flag(spark, rows):
    df = spark.createDataFrame(rows, "d string, p string").coalesce(1)
    flag = differs(parse(F.col("d")), parse(F.col("p")), T.VariantType(), T.VariantType())
    return [r[0] for r in df.select(flag).collect()]


@pytest.mark.parametrize("depth", [17, 60, 200])
def test_json_of_any_depth(spark, depth):
    rows = [
        (_deep(depth, '{"x":1}'), _deep(depth, '{"x":1,"z":2}')),
        (_deep(depth, '{"x":1}'), _deep(depth, '{"x":2,"z":2}')),
        (_deep(depth, '{"x":1}'), _deep(depth, '{"z":2}')),
        (_deep(depth, '{"x":null}'), _deep(depth, '{"z":2}')),
        (_deep(depth, "[1,2]"), _deep(depth, "[2,1]")),
        (_deep(depth, "{}"), _deep(depth, '{"z":2}')),
        (_deep(depth, "{}"), _deep(depth, "3")),
    ]
    assert _json_flag(spark, rows) == [False, True, True, False, True, False, True]


def test_wide_json_objects(spark):
    import json

    wide = {f"k{i}": {"a": i, "b": {"c": i}} for i in range(3_000)}
    more = wide | {"k7": {"a": 7, "b": {"c": 7, "z": 1}}, "own": {}}
    other = wide | {"k2999": {"a": 2999, "b": {"c": -1}}}
    text = [json.dumps(x) for x in (wide, more, other)]
    assert _json_flag(spark, [(text[0], text[1]), (text[0], text[2])]) == [False, True]
