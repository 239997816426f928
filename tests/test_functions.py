import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions import (
    address,
    as_list,
    bounded_key,
    build_params,
    canonical_json,
    clean_names,
    extract_attrs,
    merge_map,
    nested_remove,
    nested_upsert,
    path_get,
    row_hash,
    sanitize_key,
    slugify,
    strip_space,
    substitute,
    substitute_columns,
    tag_add,
    tag_value,
    targets_of,
)
from tablerecon.functions.documents import parse
from tablerecon.operators.tenants import substitute_by_row


def one(df, col):
    return df.select(col.alias("x")).first()["x"]


def each(spark, values, fn, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


def test_strip_and_clean(spark):
    assert each(spark, [" \t a b \n", "", None, "x "], strip_space) == ["a b", "", None, "x"]
    df = spark.createDataFrame(
        [(1, "A@B.C", " Ann\t", "\nLee "), (2, None, None, "x")], "id int, email string, first_name string, last_name string"
    )
    got = [tuple(r) for r in clean_names(df).orderBy("id").select("email", "full_name").collect()]
    assert got == [("a@b.c", "Ann Lee"), (None, None)]


SLUGS = ["Feature/ABC-1", "--", "", "main", "Über straße", "a" * 60, "_x_", "9/9"]


def test_slugs_and_keys(spark):
    texts = ["Team/Alpha-7", "__already__", "---", "", "a  b", "Grün 9", "v1.2.3"]
    assert each(spark, texts, slugify) == ["team_alpha_7", "already", "preview", "preview", "a_b", "gr_n_9", "v1_2_3"]
    assert each(spark, texts, sanitize_key) == ["TEAM_ALPHA_7", "ALREADY", "PREVIEW", "PREVIEW", "A_B", "GR_N_9", "V1_2_3"]
    assert each(spark, [None], slugify) == [None]


@pytest.mark.parametrize(
    "base, text, key",
    [
        ("BASE", "Team/Alpha-7", "BASE__TEAM_ALPHA_7"),
        ("BASE", "---", "BASE__PREVIEW"),
        ("BASE", "a-branch-name-that-is-far-too-long-to-fit", None),
        ("A_BASE_THAT_LEAVES_VERY_LITTLE_ROOM", "x", None),
    ],
)
def test_bounded_key(spark, base, text, key):
    got = each(spark, [text], lambda c: bounded_key(F.lit(base), slugify(c)))[0]
    if key is not None:
        assert got == key
    else:
        # too long: cut, and told apart by six digits of the slug's SHA-1
        mark = hashlib.sha1(each(spark, [text], slugify)[0].encode()).hexdigest()[:6].upper()
        assert len(got) <= 32 and got.endswith(f"_{mark}") and got.startswith(base[:19])
        assert got != each(spark, [text + "2"], lambda c: bounded_key(F.lit(base), slugify(c)))[0]


def test_address(spark):
    df = spark.createDataFrame([("t", "n"), (None, "n")], "a string, b string")
    assert [r[0] for r in df.select(address(F.col("a"), F.col("b"))).collect()] == ["t.n", None]


def test_substitute_values(spark):
    variables = {"region": "north", "shard": "s7"}
    assert each(spark, ["${region}/in", "plain", "${unknown}/x", "${region}/${shard}", None],
                lambda c: substitute(c, variables)) == ["north/in", "plain", "${unknown}/x", "north/s7", None]


def test_substitute_order_matters(spark):
    forward = [("a", "${b}"), ("b", "x")]
    assert each(spark, ["${a}"], lambda c: substitute(c, forward)) == ["x"]
    assert each(spark, ["${a}"], lambda c: substitute(c, forward[::-1])) == ["${b}"]
    many = [(f"v{i}", f"${{v{i + 1}}}") for i in range(50)]
    assert each(spark, ["${v0}"], lambda c: substitute(c, many)) == ["${v50}"]


def test_substitute_nested_types(spark):
    ddl = "s struct<a: string, n: int, m: map<string,string>, l: array<string>>, i int, none struct<a: string>"
    df = spark.createDataFrame([(("${k}", 1, {"${k}": "${k}"}, ["${k}", "z"]), 7, None)], ddl)
    row = substitute_columns(df, {"k": "v"}).first()
    assert row["s"].asDict() == {"a": "v", "n": 1, "m": {"${k}": "v"}, "l": ["v", "z"]}
    assert (row["i"], row["none"]) == (7, None)


def sequential(text, variables):
    for name, value in variables:
        text = text.replace("${" + name + "}", value)
    return text


@pytest.mark.parametrize("list_limit", [0, 1000])
def test_substitute_by_row(spark, list_limit):
    by_tenant = {
        "t1": [("a", "${b}"), ("c", "C"), ("b", "B${c}"), ("pre", "x"), ("x", "${pre}")],
        "t2": [("b", "2"), ("a", "${b}"), ("fix", "F"), ("prefix", "P")],
    }
    texts = ["${a}${b}", "${c}-${a}", "${x}${pre}", "${pre${fix}}", "${prefix}${${b}}", "none", "${unknown}", None, ""]
    records = [(f"{t}{i}", t, x, "${a}") for t in ("t1", "t2", "t3") for i, x in enumerate(texts)]
    df = spark.createDataFrame(records, "id string, t string, path string, other string")
    variables = spark.createDataFrame(
        [(t, n, v, i) for t, pairs in by_tenant.items() for i, (n, v) in enumerate(pairs)],
        "t string, name string, value string, position int",
    )
    out = substitute_by_row(df, variables, "t", ["path", "other"], list_limit=list_limit)
    assert out.columns == df.columns
    got = {r["id"]: (r["path"], r["other"]) for r in out.collect()}
    for key, tenant, path, other in records:
        pairs = by_tenant.get(tenant, [])
        assert got[key] == (path if path is None else sequential(path, pairs), sequential(other, pairs))


@pytest.mark.parametrize("list_limit", [0, 1000])
def test_substitute_by_row_on_awkward_inputs(spark, list_limit):
    """Null and repeated keys, names with braces, equal positions, null names, values and tenants."""
    df = spark.createDataFrame(
        [(None, "t", "${a} ${b}x"), ("k", "t", "${a}"), ("k", "t", "${b}"), ("n", None, "${a}"), ("z", "t", "${x}y}|${q}")],
        "key string, tenant string, path string",
    )
    variables = spark.createDataFrame(
        [("t", "a", "A${b}", 1), ("t", "b", "B", 1), ("t", "x}y", "brace", 2), ("t", None, "v", 3), ("t", "q", None, 4), (None, "a", "no", 1)],
        "tenant string, name string, value string, position int",
    )
    out = substitute_by_row(df, variables, "tenant", ["path"], list_limit=list_limit)
    assert sorted((r["key"] or "", r["path"]) for r in out.collect()) == [
        ("", "AB Bx"), ("k", "AB"), ("k", "B"), ("n", "${a}"), ("z", "brace|${q}"),
    ]


def test_path_get(spark):
    docs = ['{"a":{"b":1,"n":null}}', '{"a":5}', '{"a":[1]}', "{}", "not json"]
    assert each(spark, docs, lambda c: path_get(parse(c), "a.b", -1, "int")) == [1, -1, -1, -1, -1]
    assert each(spark, docs[:2], lambda c: path_get(parse(c), "a.n", "d")) == [None, "d"]
    assert each(spark, ['{"a b":{"c\'d":"x"}}'], lambda c: path_get(parse(c), "a b.c'd")) == ["x"]


def test_extract_attrs(spark):
    df = spark.createDataFrame([(1, '{"params":{"connection":"c","on":true},"formatType":"csv"}')], "id int, raw string")
    spec = {
        "connection": ("params.connection",),
        "path": ("params.path", "string", "none"),
        "format": ("formatType",),
        "on": ("params.on", "boolean", False),
        "schema": ("params.schema",),
    }
    row = extract_attrs(df, "raw", spec, keep=["id"]).first()
    assert row.asDict() == {"id": 1, "connection": "c", "path": "none", "format": "csv", "on": True, "schema": None}


def test_build_params(spark):
    df = spark.createDataFrame([("c", None, "csv")], "connection string, path string, format string")
    params = build_params(
        {"params.connection": F.col("connection"), "params.path": F.col("path"), "formatType": F.col("format")}
    )
    assert json.loads(one(df, params)) == {"connection": "c"}
    assert one(df, build_params({"formatType": F.col("format")})) == "{}"


def test_lists_and_tags(spark):
    s, arr = T.StringType(), T.ArrayType(T.StringType())
    assert each(spark, ["a", None], lambda c: as_list(c, s)) == [["a"], []]
    assert each(spark, [["a"], None], lambda c: as_list(c, arr), "array<string>") == [["a"], []]
    tags = [["x", "base:1", "base:2"], [], None, ["bas"]]
    assert each(spark, tags, lambda c: tag_value(c, "base:"), "array<string>") == ["1", None, None, None]
    assert each(spark, [["b", "a"], None], lambda c: tag_add(c, "c", "a"), "array<string>") == [["a", "b", "c"], ["a", "c"]]
    rules = [[("B",), ("A",), (None,), ("B",)], [], None]
    assert each(spark, rules, targets_of, "array<struct<targetProject: string>>") == [["A", "B"], [], []]


def test_merge_map(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"a": "1"}), ({"a": "1"}, None)],
        "cur map<string,string>, want map<string,string>",
    )
    got = [r[0] for r in df.select(merge_map(F.col("cur"), F.col("want"))).collect()]
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"a": "1"}, {"a": "1"}]


def test_nested_entries(spark):
    ddl = "array<struct<k: string, v: int>>"

    def upsert(c):
        return nested_upsert(
            c, lambda e: e["k"] == "a", lambda e: e.withField("v", F.lit(9)), F.struct(F.lit("a").alias("k"), F.lit(9).alias("v"))
        )

    given = [[("b", 1), ("a", 2), ("a", 3)], [("b", 1)], [], None]
    got = [[tuple(e) for e in x] for x in each(spark, given, upsert, ddl)]
    assert got == [[("b", 1), ("a", 9), ("a", 3)], [("b", 1), ("a", 9)], [("a", 9)], [("a", 9)]]
    kept = each(spark, given[:2], lambda c: nested_remove(c, lambda e: e["k"] == "a"), ddl)
    assert [[tuple(e) for e in x] for x in kept] == [[("b", 1)], [("b", 1)]]


def test_canonical_json(spark):
    assert each(spark, ['{ "b": [1, {"z":1,"y":null}], "a": "x" }', "bad"], canonical_json) == [
        '{"a":"x","b":[1,{"y":null,"z":1}]}', None]
    df = spark.createDataFrame([({"b": {"z": 1, "a": 2}, "a": {}}, None)], "m map<string,map<string,int>>, n string")
    text = one(df, canonical_json(F.struct("n", "m"), df.select(F.struct("n", "m").alias("s")).schema["s"].dataType))
    assert text == '{"m":{"a":{},"b":{"a":2,"z":1}},"n":null}'


def test_row_hash(spark):
    df = spark.createDataFrame([("x", 1, None)], "b string, a int, c string")
    want = hashlib.sha256(b'{"a":1,"b":"x","c":null}').hexdigest()
    assert one(df, row_hash(df)) == want
    assert one(df.select("c", "b", "a"), row_hash(df.select("c", "b", "a"))) == want
    assert one(df, row_hash(df, ["a"])) == hashlib.sha256(b'{"a":1}').hexdigest()
