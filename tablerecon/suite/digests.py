"""Hashes, digests and the stale check over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.hashing import row_hash
from tablerecon.operators.digest import bucket_digests, config_digest, is_stale, table_digest
from tablerecon.suite.pairs import CUSTOMER_PAIR, customer_desired, customer_prior
from tablerecon.suite.registry import Tables, query

CUSTOMER_JSON = """'{"c_acctbal":"' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '","c_custkey":' || c_custkey
  || ',"c_mktsegment":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END
  || ',"c_name":"' || c_name || '"}'"""

LINE_JSON = """'{"l_discount":' || CAST(l_discount AS VARCHAR) || ',"l_extendedprice":' || CAST(l_extendedprice AS VARCHAR)
  || ',"l_linenumber":' || l_linenumber || ',"l_linestatus":"' || l_linestatus || '","l_orderkey":' || l_orderkey
  || ',"l_partkey":' || l_partkey || ',"l_quantity":' || CAST(l_quantity AS VARCHAR) || ',"l_returnflag":"' || l_returnflag
  || '","l_shipdate":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || '","l_suppkey":' || l_suppkey
  || ',"l_tax":' || CAST(l_tax AS VARCHAR) || '}'"""

ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')
  || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus
  || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || '}'"""

PART_JSON = """'{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || '}'"""


def _customers(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        "c_name",
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )


def _buckets(json: str, table: str) -> str:
    pieces = ", ".join(f"CAST('0x' || substr(h, {1 + 14 * i}, 14) AS BIGINT) AS p{i}" for i in range(4))
    sums = ", ".join(
        f"CAST(sum(p{i} >> 28) AS BIGINT) AS hi{i}, CAST(sum(p{i} & 268435455) AS BIGINT) AS lo{i}" for i in range(4)
    )
    line = " || ':' || ".join(["bucket", "rows", *[f"hi{i} || ':' || lo{i}" for i in range(4)]])
    return f"""hashed AS (SELECT sha256({json}) AS h FROM {table}),
pieces AS (SELECT substr(h, 1, 2) AS bucket, {pieces} FROM hashed),
summed AS (SELECT bucket, CAST(count(*) AS BIGINT) AS rows, {sums} FROM pieces GROUP BY 1),
buckets AS (SELECT bucket, rows, sha256({line}) AS bucket_digest FROM summed)"""


def _digest(header: str) -> str:
    return f"""SELECT CAST(sum(rows) AS BIGINT) AS rows,
  sha256({header} || chr(10) || string_agg(bucket || ':' || bucket_digest, chr(10) ORDER BY bucket)) AS digest FROM buckets"""


@query(f"SELECT c_custkey, sha256({CUSTOMER_JSON}) AS row_hash FROM customer")
def row_hash_customer(t: Tables) -> DataFrame:
    rows = _customers(t)
    return rows.select("c_custkey", row_hash(rows).alias("row_hash"))


@query(f"SELECT o_orderkey, sha256({ORDER_JSON}) AS row_hash FROM orders")
def row_hash_orders(t: Tables) -> DataFrame:
    """Timestamps and doubles are hashed whole."""
    rows = t.orders
    return rows.select("o_orderkey", row_hash(rows).alias("row_hash"))


@query(f"WITH {_buckets(LINE_JSON, 'lineitem')} SELECT bucket, rows, bucket_digest FROM buckets")
def bucket_digests_lineitem(t: Tables) -> DataFrame:
    rows = t.lineitem
    return bucket_digests(rows.select(row_hash(rows).alias("row_hash")))


@query("WITH " + _buckets(LINE_JSON, "lineitem") + " " + _digest("'lineage=base,serial=3'"))
def table_digest_bucketed(t: Tables) -> DataFrame:
    return table_digest(t.lineitem, meta={"lineage": "base", "serial": 3})


@query("WITH " + _buckets(PART_JSON, "part") + " " + _digest("''"))
def config_digest_part(t: Tables) -> DataFrame:
    """Dependency lists take no part in a config digest."""
    desired = t.part.select("p_partkey", "p_name", "p_brand", F.array("p_type").alias("depends_on"))
    return config_digest(desired)


@query(
    f"""WITH {CUSTOMER_PAIR},
d AS (SELECT count(*) AS n FROM ((SELECT * FROM desired EXCEPT SELECT * FROM prior) UNION ALL
  (SELECT * FROM prior EXCEPT SELECT * FROM desired)))
SELECT n > 0 AS stale, CASE WHEN n > 0 THEN 'digest changed' END AS reason FROM d"""
)
def stale_reason(t: Tables) -> DataFrame:
    """A plan made on one customer table against the other, at the same serial."""

    def version(df: DataFrame) -> DataFrame:
        return table_digest(df).select(F.lit("base").alias("lineage"), F.lit(4).alias("serial"), "digest")

    return is_stale(version(customer_desired(t)), version(customer_prior(t)))
