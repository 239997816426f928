"""Sources, sinks and recipes over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon import recipes as R
from tablerecon.functions import clean_names
from tablerecon.operators.quality import not_empty_report, qa_frame, qa_sql
from tablerecon.session import scratch_path
from tablerecon.sources import (
    Connection,
    FileDataset,
    SqlDataset,
    read_csv_upload,
    read_files,
    read_folder,
    read_foreign,
    write_files,
    write_table,
    write_with_schema,
)
from tablerecon.suite.functions import RAW_CUSTOMERS, raw_customers
from tablerecon.suite.registry import Tables, query
from tablerecon.types import Column

CUSTOMER_COLUMNS = (
    Column("c_custkey", "bigint"),
    Column("c_name", "string"),
    Column("c_nationkey", "int"),
    Column("c_mktsegment", "string"),
)

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def _plain(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(
    """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"""
)
def scan_parquet_orders(t: Tables) -> DataFrame:
    columns = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderdate", "timestamp_ntz")]
    rows = read_files(t.spark, t.path("orders"), "parquet", columns=columns)
    recent = rows.filter(F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return recent.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"))


@query(CUSTOMER)
def scan_csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    params = {"separator": ";", "charset": "UTF-8", "quoteChar": '"', "escapeChar": "\\", "parseHeaderRow": True}
    write_files(_plain(t), path, format="csv", format_params=params)
    return read_csv_upload(t.spark, path, params, CUSTOMER_COLUMNS)


@query("SELECT doc_id, text, lang FROM documents")
def scan_json_roundtrip(t: Tables) -> DataFrame:
    """Whole texts through JSON lines."""
    path = scratch_path(t.spark, "json")
    write_files(t.documents.select("doc_id", "text", "lang"), path, format="json")
    return read_files(t.spark, path, "json", columns=[("doc_id", "bigint"), ("text", "string"), ("lang", "string")])


@query(CUSTOMER)
def scan_orc_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orc")
    write_files(_plain(t), path, format="orc")
    return read_files(t.spark, path, "orc", columns=CUSTOMER_COLUMNS)


@query("SELECT c_name AS value FROM customer")
def scan_text_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "text")
    write_files(t.customer.select("c_name"), path, format="text")
    return read_files(t.spark, path, "text")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def query_dataset_active_customers(t: Tables) -> DataFrame:
    """A query as the dataset, on Spark's own connection."""
    here = Connection("spark", {})
    text = f"SELECT c_custkey, c_name FROM parquet.`{t.path('customer')}` WHERE c_acctbal > 0"
    return SqlDataset(here, "query", query=text).read(t.spark)


@query(
    """SELECT c_custkey, c_mktsegment, CAST(2 AS BIGINT) AS copies FROM customer"""
)
def write_append_twice(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    target = FileDataset(path)
    for _ in range(2):
        target.write(_plain(t), "APPEND")
    stored = target.read(t.spark)
    return stored.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("copies"))


@query(CUSTOMER)
def write_overwrite(t: Tables) -> DataFrame:
    target = FileDataset(scratch_path(t.spark, "overwrite"))
    target.write(t.customer.select("c_custkey"))
    target.write(_plain(t))
    return target.read(t.spark)


@query("SELECT c_custkey, c_name FROM customer")
def write_truncate(t: Tables) -> DataFrame:
    """The rows are replaced, the stored schema stays."""
    target = FileDataset(scratch_path(t.spark, "truncate"))
    target.write(t.customer.select("c_custkey", F.lit("old").alias("c_name")))
    target.write(_plain(t), "TRUNCATE")
    return target.read(t.spark)


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 1 AS marks FROM customer")
def foreign_table(t: Tables) -> DataFrame:
    """A table written with its schema and read back through an alias."""
    path = scratch_path(t.spark, "foreign")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write_with_schema(_plain(t).withColumn("marks", F.lit(1)), table, path)
    return read_foreign(t.spark, "shared_customers", {"shared_customers": f"default.{table}"})


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def table_truncate(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "table")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write_table(_plain(t).withColumn("c_name", F.lit("old")), table, path=path)
    write_table(_plain(t).withColumn("extra", F.lit(1)), table, "TRUNCATE")
    return t.spark.table(table)


@query(
    """SELECT 'lang=' || lang || '/source=' || source AS part, CAST(1 AS BIGINT) AS files, TRUE AS has_bytes
FROM documents GROUP BY lang, source"""
)
def folder_inventory(t: Tables) -> DataFrame:
    """A folder written from ``documents``, one file per language and source, and what it holds."""
    path = scratch_path(t.spark, "folder")
    rows = t.documents.select("doc_id", "text", "lang", "source")
    write_files(rows.repartition("lang", "source"), path, partition_by=["lang", "source"])
    found = read_folder(t.spark, path, "*.parquet")
    part = F.regexp_extract("path", r"(lang=[^/]+/source=[^/]+)/", 1)
    return found.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("files"), (F.min("length") > 0).alias("has_bytes")
    )


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_documents(t: Tables) -> DataFrame:
    """Whole texts, with their line breaks and quotes, through CSV and back in another column order."""
    path = scratch_path(t.spark, "csv-documents")
    params = {
        "separator": ";", "quoteChar": "'", "escapeChar": "\\", "parseHeaderRow": True, "probableNumberOfRecords": 1000,
    }
    write_files(t.documents, path, format="csv", format_params=params)
    columns = [("n_chars", "bigint"), "source", "lang", "text", ("doc_id", "bigint")]
    return read_csv_upload(t.spark, path, params, columns)


@query(CUSTOMER)
def sync_customer(t: Tables) -> DataFrame:
    target = FileDataset(scratch_path(t.spark, "sync"), columns=CUSTOMER_COLUMNS)
    return R.sync(t.spark, FileDataset(t.path("customer")), target).read(t.spark)


@query(
    f"""WITH {RAW_CUSTOMERS}
SELECT coalesce(segment, 'none') AS segment, count(*) AS customers, count(DISTINCT email) AS emails,
  max(customer_id) AS newest FROM raw GROUP BY 1"""
)
def sql_recipe_quality(t: Tables) -> DataFrame:
    sql = """WITH named AS (SELECT coalesce(segment, 'none') AS segment, email, customer_id FROM people)
      SELECT segment, count(*) AS customers, count(DISTINCT email) AS emails, max(customer_id) AS newest
      FROM named GROUP BY segment"""
    return R.sql_recipe(t.spark, sql, {"people": raw_customers(t)})


@query(
    """SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS orders, '${keep}' AS tag FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)"""
)
def sql_recipe_rollup(t: Tables) -> DataFrame:
    """Joins and grouping sets come with Spark SQL; templates in the text survive."""
    sql = """WITH joined AS (SELECT * FROM o JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey)
    SELECT c_mktsegment, n_name, count(*) AS orders, '${keep}' AS tag FROM joined GROUP BY ROLLUP (c_mktsegment, n_name)"""
    return R.sql_recipe(t.spark, sql, {"o": t.orders, "c": t.customer, "n": t.nation})


@query(
    f"""WITH {RAW_CUSTOMERS}
SELECT customer_id, lower(email) AS email, first_name || ' ' || last_name AS full_name FROM raw"""
)
def py_recipe_clean(t: Tables) -> DataFrame:
    """A Python recipe over DataFrames, written to its first output and read back."""
    out = FileDataset(scratch_path(t.spark, "curated"))
    R.py_recipe(lambda raw: clean_names(raw).select("customer_id", "email", "full_name"), [raw_customers(t)], out)
    return out.read(t.spark)


@query(
    """SELECT lower(c_mktsegment) AS instance, c_custkey, c_name FROM customer
WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal >= CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 5000 ELSE 0 END"""
)
def fan_out_segments(t: Tables) -> DataFrame:
    """One template, an instance per segment with its own parameter, all in one scan."""
    floors = {"building": 100, "machinery": 5000, "household": 0, "automobile": 0}

    def template(name: str, floor: int) -> tuple:
        met = (F.col("c_mktsegment") == name.upper()) & (F.col("c_acctbal") >= floor)
        return name, (met, {"c_custkey": F.col("c_custkey"), "c_name": F.col("c_name")})

    made = R.fan_out(lambda name, floor: [template(name, floor)], {n: {"floor": f} for n, f in floors.items()})
    return R.fan_out_rows(t.customer, dict(made))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def fan_out_one_write(t: Tables) -> DataFrame:
    """All instances in one scan and one write: a directory per segment."""
    path = scratch_path(t.spark, "instances")
    R.fan_out_write(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", path)
    return read_files(t.spark, path, columns=[("c_custkey", "bigint"), "c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'customers.preview.feature_x_1.parquet' AS target FROM customer")
def isolated_sync(t: Tables) -> DataFrame:
    """The same flow routed to a branch's own path; the base path stays unwritten."""
    base = FileDataset(scratch_path(t.spark, "flow") + "/customers.parquet", columns=CUSTOMER_COLUMNS)
    target = R.isolated(t.spark, base, "Feature/X-1")
    out = R.sync(t.spark, FileDataset(t.path("customer")), target)
    return out.read(t.spark).withColumn("target", F.lit(out.path.rsplit("/", 1)[1]))


@query(
    f"""WITH {RAW_CUSTOMERS}
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_email,
  CAST(sum(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_segment FROM raw"""
)
def qa_checks(t: Tables) -> DataFrame:
    return qa_sql(raw_customers(t), ["email", "segment"])


@query(
    f"""WITH {RAW_CUSTOMERS}
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_email
FROM raw HAVING count(*) > 0"""
)
def customers_quality(t: Tables) -> DataFrame:
    return qa_frame(raw_customers(t), ["email"])


@query(
    """SELECT 'customer' AS table_name, count(*) > 0 AS has_rows FROM customer
UNION ALL SELECT 'overdrawn_orders', count(*) > 0 FROM orders WHERE o_totalprice < 0"""
, "not_empty_report")
def _not_empty_report(t: Tables) -> DataFrame:
    return not_empty_report(customer=t.customer, overdrawn_orders=t.orders.filter("o_totalprice < 0"))


@query("SELECT doc_id, text, lang, source FROM documents")
def scan_csv_mixed_headers(t: Tables) -> DataFrame:
    """Two folders of quoted CSV with their columns in different orders, read as one dataset."""
    path = scratch_path(t.spark, "mixed")
    params = {"parseHeaderRow": True, "style": "excel"}
    rows = t.documents.select("doc_id", "text", "lang", "source")
    write_files(rows.filter("doc_id % 2 = 0"), f"{path}/a", format="csv", format_params=params)
    turned = rows.filter("doc_id % 2 = 1").select("source", "text", "doc_id", "lang")
    write_files(turned, f"{path}/b", format="csv", format_params=params)
    columns = [("doc_id", "bigint"), "text", "lang", "source"]
    return read_files(t.spark, [f"{path}/a", f"{path}/b"], "csv", params, columns)
