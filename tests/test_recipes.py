import pytest
from pyspark.sql import functions as F

from tablerecon import recipes as R
from tablerecon.errors import ValidationError
from tablerecon.session import scratch_path
from tablerecon.sources import FileDataset
from tablerecon.types import Column


def test_sync(spark, rows):
    src, dst = FileDataset(scratch_path(spark, "a")), FileDataset(scratch_path(spark, "b"), "csv", {"parseHeaderRow": True})
    src.write(spark.createDataFrame([(1, "x")], "id int, s string"))
    R.sync(spark, src, dst, columns=[Column("s"), Column("id", "bigint")])
    assert dst.read(spark).columns == ["s", "id"]
    R.sync(spark, src, dst, "APPEND", columns=[Column("s"), Column("id", "bigint")])
    assert dst.read(spark).count() == 2


def test_sql_recipe(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    out = R.sql_recipe(spark, "WITH w AS (SELECT * FROM `my-input`) SELECT max(id) AS m, '${keep}' AS t FROM w -- end", {"my-input": a})
    assert tuple(out.first()) == (2, "${keep}")
    a.createOrReplaceTempView("session_view")
    for text in ("SELECT * FROM session_view", "SELECT * FROM a WHERE id IN (SELECT id FROM session_view)", "SELECT * FROM default.t"):
        with pytest.raises(ValidationError, match="not an input"):
            R.sql_recipe(spark, text, {"a": a})
    spark.catalog.dropTempView("session_view")
    before = spark.conf.get("spark.sql.variable.substitute")
    with pytest.raises(Exception, match="other_table"):
        R.sql_recipe(spark, "SELECT * FROM other_table", {"a": a})
    assert spark.conf.get("spark.sql.variable.substitute") == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__in_")]
    with pytest.raises(ValidationError, match="at least one input"):
        R.sql_recipe(spark, "SELECT 1", {})


def test_py_recipe_passes_inputs_in_order(spark, rows):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    out = FileDataset(scratch_path(spark, "py"))
    got = R.py_recipe(lambda p, q: p.withColumn("side", F.lit("p")).unionByName(q.withColumn("side", F.lit("q"))), [a, b], out)
    assert rows(got) == rows(out.read(spark)) == [(1, "p"), (2, "q")]
    assert R.py_recipe(lambda: a) is a


def test_fan_out():
    assert R.fan_out(lambda name, n: [(name, n), name], {"a": {"n": 1}, "b": {"n": 2}}) == [("a", 1), "a", ("b", 2), "b"]
    assert R.fan_out(lambda n: [n], with_={"n": 3}) == [3]
    for bad in ({}, {"instances": {}, "with_": {}}):
        with pytest.raises(ValidationError, match="exactly one"):
            R.fan_out(lambda: [], **bad)


def test_isolated_paths(spark):
    assert R.isolated_path(spark, "/data/state.json", "Feature/X") == "/data/state.preview.feature_x.json"
    assert R.isolated_path(spark, "/data/t.snappy.parquet", "--") == "/data/t.preview.preview.snappy.parquet"
    assert R.isolated_path(spark, "s3a://b/t/", "main") == "s3a://b/t.preview.main"
    target = FileDataset("/d/t.parquet", columns=(Column("a"),))
    assert R.isolated(spark, target, "x").columns == target.columns


def test_a_recipe_reads_its_inputs_only(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "id int, t string")
    secret = spark.createDataFrame([(7, "s")], "id int, t string")
    secret.createOrReplaceTempView("secret")
    secret.createOrReplaceGlobalTempView("secret_too")
    secret.write.mode("overwrite").saveAsTable("stored_secret")
    path = scratch_path(spark, "direct")
    secret.write.parquet(path)
    refused = [
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM one WHERE id IN (SELECT id FROM secret)",
        "SELECT (SELECT max(id) FROM secret) AS m FROM one",
        "SELECT * FROM stored_secret",
        "SELECT * FROM one WHERE EXISTS (SELECT 1 FROM default.stored_secret)",
        "SELECT * FROM global_temp.secret_too",
        f"SELECT * FROM parquet.`{path}`",
        "WITH a AS (SELECT * FROM one), b AS (SELECT * FROM a JOIN secret USING (id)) SELECT * FROM b",
    ]
    for sql in refused:
        with pytest.raises(ValidationError, match="not an input"):
            R.sql_recipe(spark, sql, {"one": one})
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN 2 * x")
    allowed = {
        "WITH one AS (SELECT id + 1 AS id FROM one) SELECT id FROM one": 2,
        "WITH secret AS (SELECT id FROM one) SELECT id FROM secret": 1,
        "SELECT length('UnresolvedRelation [foo]') + id * 0 FROM one": 24,
        "SELECT id + x FROM one CROSS JOIN (VALUES (3)) AS v(x)": 4,
        "SELECT twice(id) FROM One": 2,
    }
    for sql, want in allowed.items():
        assert R.sql_recipe(spark, sql, {"one": one}).first()[0] == want
    assert spark.table("secret").count() == 1
    spark.sql("DROP TABLE stored_secret")
    spark.catalog.dropTempView("secret")
    spark.catalog.dropGlobalTempView("secret_too")


def test_input_names_of_any_kind(spark):
    one = spark.createDataFrame([(1,)], "id int")
    assert R.sql_recipe(spark, "SELECT id FROM `my table`", {"my table": one}).first()[0] == 1
