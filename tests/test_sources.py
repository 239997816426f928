import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import ValidationError
from tablerecon.operators.schema import conform_schema, schema_mismatch
from tablerecon.session import scratch_path
from tablerecon.sources import (
    read_csv_upload,
    Connection,
    FileDataset,
    Split,
    SqlDataset,
    csv_options,
    drop_dataset,
    merge_params,
    read_files,
    read_folder,
    read_foreign,
    upload_dataset,
    write_files,
    write_table,
    write_with_schema,
)
from tablerecon.types import Column, declared_schema

PG = Connection("pg", {"url": "jdbc:postgresql://h/db", "user": "u"})


def test_declared_types(spark):
    names = "string int bigint float double boolean date array object map".split()
    schema = declared_schema([(n, n) for n in names])
    assert [f.dataType.simpleString() for f in schema] == [
        "string", "int", "bigint", "float", "double", "boolean", "date", "array<string>", "variant", "map<string,string>",
    ]
    assert Column("d", "date").data_type("timestamp_ntz") == T.TimestampNTZType()
    assert Column("d", "decimal(10,2)").data_type() == T.DecimalType(10, 2)
    with pytest.raises(ValueError, match="name"):
        Column("")


def test_conform_schema(spark):
    df = spark.createDataFrame([("7", "x", '{"b":1}', '["q"]', "drop")], "a string, b string, o string, l string, z string")
    columns = [Column("a", "int", "the a", "id"), ("b", "double"), ("o", "object"), ("l", "array"), ("new", "map")]
    out = conform_schema(df, columns)
    row = out.select("a", "b", F.to_json("o").alias("o"), "l", "new").first()
    assert tuple(row) == (7, None, '{"b":1}', ["q"], None)
    assert out.schema["a"].metadata == {"comment": "the a", "meaning": "id"}
    assert out.schema["b"].metadata == {"comment": ""}
    assert conform_schema(df, []) is df


def test_strict_schema(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert conform_schema(df, [("a", "int"), "b"], strict=True) is df
    with pytest.raises(ValidationError, match="column 0"):
        conform_schema(df, ["b", ("a", "int")], strict=True)
    assert len(schema_mismatch(df, [("a", "int"), "b", "c"])) == 1


def test_csv_options():
    params = {"separator": ";", "charset": "UTF-8", "quoteChar": '"', "escapeChar": "\\", "parseHeaderRow": True, "compress": ""}
    assert csv_options(params) == {"sep": ";", "encoding": "UTF-8", "quote": '"', "escape": "\\", "header": "true", "multiLine": "true"}
    with pytest.raises(ValueError, match="some, thing"):
        csv_options({"style": "unix", "skipRowsBeforeHeader": 0, "thing": 1, "some": 2})
    assert csv_options({"style": "excel"})["escape"] == '"' and csv_options({"multiLine": False})["multiLine"] == "false"
    assert merge_params({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="unknown format"):
        FileDataset("/x", "xml").read(None) if False else write_files(None, "/x", format="xml")


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, format, rows):
    df = spark.createDataFrame([(1, "a;b", 1.5), (2, 'q"x', None)], "id int, s string, d double")
    path = scratch_path(spark, "fmt")
    params = {"separator": ";", "parseHeaderRow": True} if format == "csv" else {}
    target = FileDataset(path, format, params, (Column("id", "int"), Column("s"), Column("d", "double")))
    target.write(df)
    assert rows(target.read(spark)) == rows(df)


def test_nested_csv_cells(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, '{"a":"b"}', '["x","y"]')], "id int, m string, l string").write.csv(path, sep="|")
    up = upload_dataset(path, {"separator": "|"}, columns=(Column("id", "int"), Column("m", "map"), Column("l", "array")))
    assert up.managed and tuple(up.read(spark).first()) == (1, {"a": "b"}, ["x", "y"])


def test_write_modes(spark, rows):
    path = scratch_path(spark, "modes")
    one = spark.createDataFrame([(1, "a")], "id int, s string")
    target = FileDataset(path)
    target.write(one)
    target.write(one, "APPEND")
    assert target.read(spark).count() == 2
    other = spark.createDataFrame([("7", 1.0)], "id string, extra double")
    target.write(other, "TRUNCATE")
    assert target.read(spark).columns == ["id", "s"] and rows(target.read(spark)) == [(7, None)]
    target.write(other)
    assert target.read(spark).columns == ["id", "extra"]
    with pytest.raises(ValueError, match="write mode"):
        target.write(one, "MERGE")


def test_tables(spark, rows):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    write_with_schema(df, "t_managed")
    write_table(df.select("s", "id"), "t_managed", "APPEND")
    assert rows(read_foreign(spark, "alias", {"alias": "default.t_managed"})) == [(1, "a"), (1, "a")]
    path = scratch_path(spark, "external")
    write_table(df, "t_external", path=path)
    write_table(df.withColumn("id", F.lit(5)), "t_external", "TRUNCATE")
    assert rows(spark.table("t_external")) == [(5, "a")]
    drop_dataset(spark, "t_external")
    assert rows(spark.read.parquet(path)) == [(5, "a")]
    drop_dataset(spark, "t_managed")
    assert not spark.catalog.tableExists("t_managed")


def test_jdbc_options():
    table = SqlDataset(PG, "table", "public", "orders", catalog="db", split=Split("id", "0", "100", 16))
    assert table.read_options() == {
        "url": "jdbc:postgresql://h/db", "user": "u", "dbtable": "db.public.orders",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "16",
    }
    query = SqlDataset(PG, "query", query="SELECT 1")
    assert query.read_options()["query"] == "SELECT 1" and "dbtable" not in query.read_options()
    split = SqlDataset(PG, "query", query="SELECT * FROM t", split=Split("id", "0", "9", 2))
    assert split.read_options()["dbtable"] == "(SELECT * FROM t) q"
    assert SqlDataset(PG, table="t", write_mode="TRUNCATE").write_options()["truncate"] == "true"
    assert "truncate" not in SqlDataset(PG, table="t").write_options()


@pytest.mark.parametrize(
    "bad",
    [
        {"mode": "table"},
        {"mode": "table", "table": "t", "query": "q"},
        {"mode": "query"},
        {"mode": "query", "query": "q", "table": "t"},
        {"mode": "view", "table": "t"},
        {"table": "t", "write_mode": "MERGE"},
    ],
)
def test_sql_dataset_rules(bad):
    with pytest.raises(ValidationError):
        SqlDataset(PG, **bad)


def test_query_on_spark_itself(spark):
    here = Connection("spark", {})
    assert SqlDataset(here, "query", query="SELECT 1 AS x").read(spark).first()["x"] == 1
    with pytest.raises(ValidationError, match="cannot be written"):
        SqlDataset(here, "query", query="SELECT 1").write(None)


def test_folder(spark):
    path = scratch_path(spark, "folder")
    spark.range(3).coalesce(1).write.parquet(path)
    listed = read_folder(spark, path, "*.parquet").collect()
    assert len(listed) == 1 and listed[0]["length"] > 0 and listed[0]["name"].endswith(".parquet")
    assert "content" not in read_folder(spark, path).columns


def test_filters_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "scan")
    spark.range(10).select("id", F.col("id").cast("string").alias("s"), F.rand().alias("r")).write.parquet(path)
    df = read_files(spark, path, columns=[("id", "bigint"), "s"]).filter("id > 5").select("id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in text and "ReadSchema: struct<id:bigint>" in text


def test_csv_columns_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,email\n"line one\nline two",x@example.org\n')
    got = read_csv_upload(spark, str(tmp_path), {"parseHeaderRow": True}, ["email", "name", "other"])
    assert [tuple(r) for r in got.collect()] == [("x@example.org", "line one\nline two", None)]


def test_csv_rows_before_and_after_the_header(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.csv").write_text(f"made by a tool\nid;ok\nunits;-\n{n};yes\n{n}0;0\n")
    params = {
        "separator": ";", "parseHeaderRow": True, "skipRowsBeforeHeader": 1, "skipRowsAfterHeader": 1, "normalizeBooleans": True,
    }
    got = read_csv_upload(spark, str(tmp_path), params, [("ok", "boolean"), ("id", "int")])
    assert sorted(tuple(r) for r in got.collect()) == [(False, 10), (False, 20), (True, 1), (True, 2)]


def test_csv_parameters_are_known_or_refused(spark):
    for bad in ({"nothing": 1}, {"style": "odd"}, {"arrayMapFormat": "hive"}):
        with pytest.raises(ValueError):
            read_csv_upload(spark, "/nowhere", bad, ["a"])
