"""Joins and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
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
from tablerecon.operators.skew import sketched_join
from tablerecon.session import scratch_path
from tablerecon.sources import write_table
from tablerecon.suite.registry import Tables, query


@query(
    """WITH risk AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS risk_score, 'R' AS c_mktsegment FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, c.c_mktsegment, r.c_mktsegment AS c_mktsegment_ref, coalesce(risk_score, 0) AS risk_score,
  CAST(0 AS INTEGER) AS other FROM customer c LEFT JOIN risk r ON c_custkey = o_custkey"""
)
def enrich_customers(t: Tables) -> DataFrame:
    """Customers with a score from the reference side; clashing names get a suffix."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    risk = urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("risk_score"), F.max(F.lit("R")).alias("c_mktsegment")
    )
    left = t.customer.select("c_custkey", "c_mktsegment")
    return left_enrich(left, risk, "c_custkey", fill={"risk_score": 0, "other": 0})


@query(
    """WITH s AS (SELECT nullif(s_nationkey, 3) AS k, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY 1)
SELECT c_custkey, suppliers FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c
LEFT JOIN s ON c.k IS NOT DISTINCT FROM s.k"""
)
def enrich_null_safe(t: Tables) -> DataFrame:
    """A null key meets the null key of the other side."""
    left = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    right = t.supplier.groupBy(F.nullif("s_nationkey", F.lit(3)).alias("k")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )
    return left_enrich(left, right, "k", null_safe=True).select("c_custkey", "suppliers")


@query(
    """WITH nodes AS (SELECT 'part.' || p_partkey AS address, 'part' AS type, CAST(p_partkey AS VARCHAR) AS name FROM part
  UNION ALL SELECT 'supplier.' || s_suppkey, 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier),
explicit AS (SELECT 'part.' || p_partkey AS address, 'supplier.0' AS dep, 0 AS kind FROM part),
refs AS (
  SELECT 'part.' || l_partkey AS address, CAST(l_suppkey AS VARCHAR) AS ref,
         CASE WHEN l_returnflag = 'R' THEN 'supplier' END AS type FROM lineitem),
found AS (SELECT r.address, n.address AS dep, 1 AS kind FROM refs r JOIN nodes n
  ON n.name = r.ref AND (r.type IS NULL OR r.type = n.type) WHERE n.address <> r.address)
SELECT address, dep, CASE min(kind) WHEN 0 THEN 'explicit' ELSE 'reference' END AS how
FROM (SELECT * FROM explicit UNION ALL SELECT * FROM found) GROUP BY 1, 2"""
)
def resolve_refs_edges(t: Tables) -> DataFrame:
    """Parts depend on what their lines name: by type and name, or by name alone."""
    none = F.array().cast("array<string>")
    name = F.col("p_partkey").cast("string")
    parts = t.part.select(
        F.concat(F.lit("part."), name).alias("address"), F.lit("part").alias("resource_type"), name.alias("name"),
        F.array(F.lit("supplier.0")).alias("depends_on"),
    )
    supp = F.col("s_suppkey").cast("string")
    suppliers = t.supplier.select(
        F.concat(F.lit("supplier."), supp).alias("address"), F.lit("supplier").alias("resource_type"),
        supp.alias("name"), none.alias("depends_on"),
    )
    refs = t.lineitem.select(
        F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("address"),
        F.col("l_suppkey").cast("string").alias("ref_name"),
        F.when(F.col("l_returnflag") == "R", "supplier").alias("ref_type"),
        F.col("l_orderkey").alias("position"),
    )
    edges = resolve_refs(parts.unionByName(suppliers), refs)
    how = F.when(F.col("explicit"), "explicit").otherwise("reference")
    return edges.select("address", "dep", how.alias("how"))


OVERLAY = """desired AS (SELECT c_custkey, c_nationkey, 'desired' AS side, c_mktsegment FROM customer WHERE c_acctbal >= 5000),
prior AS (SELECT c_custkey, c_nationkey, 'prior' AS side, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer),
shown AS (SELECT *, 0 AS rank, -c_custkey AS pos FROM desired
  UNION ALL SELECT *, 1, c_custkey FROM prior WHERE c_custkey NOT IN (SELECT c_custkey FROM desired))"""


def _overlay(t: Tables) -> DataFrame:
    desired = t.customer.filter("c_acctbal >= 5000").select(
        "c_custkey", "c_nationkey", F.lit("desired").alias("side"), "c_mktsegment"
    )
    prior = t.customer.select(
        "c_custkey", "c_nationkey", F.lit("prior").alias("side"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )
    return overlay(desired, prior, "c_custkey", "c_custkey")


@query(f"WITH {OVERLAY} SELECT c_custkey, side, c_mktsegment FROM shown")
def overlay_customer(t: Tables) -> DataFrame:
    return _overlay(t).select("c_custkey", "side", "c_mktsegment")


@query(
    f"""WITH {OVERLAY},
best AS (SELECT c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
  ORDER BY rank, pos) AS rn FROM shown WHERE side LIKE '%ior') WHERE rn = 1)
SELECT s_suppkey, c_mktsegment AS segment FROM supplier LEFT JOIN best ON s_nationkey = c_nationkey"""
)
def lookup_first_attr(t: Tables) -> DataFrame:
    """Segment of the first stored candidate of a supplier's nation; null stays null."""
    refs = t.supplier.select("s_suppkey", "s_nationkey")
    found = lookup_first(
        refs, _overlay(t), "c_nationkey", "c_mktsegment",
        type_col="side", type_suffix="ior", out="segment", ref="s_nationkey",
    )
    return found.select("s_suppkey", "segment")


@query(
    """SELECT c_custkey, last_order FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
)
def lookup_last_id(t: Tables) -> DataFrame:
    refs = t.customer.select("c_custkey")
    return lookup_last(refs, t.orders, "o_custkey", "o_orderkey", "o_orderkey", ref="c_custkey", out="last_order")


def _part_refs(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.array("p_name", "p_brand", "p_name", "p_type").alias("inputs"),
        F.array("p_type").alias("outputs"),
    )


def _aliases(t: Tables) -> DataFrame:
    """Names of promoted parts stand for their longest brand's object."""
    promoted = t.part.filter("p_type = 'PROMO'")
    return promoted.groupBy(F.col("p_name").alias("name")).agg(
        F.concat(F.max("p_brand"), F.lit("."), F.max("p_name")).alias("target")
    )


ALIASED = """WITH a AS (SELECT p_name AS name, max(p_brand) || '.' || max(p_name) AS target FROM part
  WHERE p_type = 'PROMO' GROUP BY 1)
SELECT p_partkey, coalesce(n.target, p_name) || ',' || coalesce(b.target, p_brand) || ',' || coalesce(n.target, p_name)
  || ',' || coalesce(t.target, p_type) AS inputs, coalesce(t.target, p_type) AS outputs
FROM part LEFT JOIN a n ON n.name = p_name LEFT JOIN a b ON b.name = p_brand LEFT JOIN a t ON t.name = p_type"""


def _joined(df: DataFrame) -> DataFrame:
    return df.select(
        "p_partkey", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs")
    )


@query(ALIASED, "resolve_aliases")
def _resolve_aliases(t: Tables) -> DataFrame:
    return _joined(resolve_aliases(_part_refs(t), ["inputs", "outputs"], _aliases(t)))


@query(ALIASED)
def resolve_aliases_joined(t: Tables) -> DataFrame:
    """The same for alias sets too large to inline."""
    return _joined(resolve_aliases(_part_refs(t), ["inputs", "outputs"], _aliases(t), inline_limit=0))


@query(
    """WITH scopes AS (
  SELECT 0 AS rank, p_brand AS grp, p_name AS name, 'default' AS value, min(p_partkey) AS pos FROM part GROUP BY 2, 3
  UNION ALL SELECT 1, p_brand, p_name, max(p_type), min(p_partkey) FROM part WHERE p_size >= 25 GROUP BY 2, 3
  UNION ALL SELECT 2, p_brand, p_name, 'local', min(p_partkey) FROM part WHERE p_type = 'PROMO' GROUP BY 2, 3)
SELECT grp, name, arg_max(value, rank) AS value, CAST(min(rank) AS INTEGER) AS first_scope, arg_min(pos, rank) AS first_position
FROM scopes GROUP BY 1, 2"""
)
def layered_variables(t: Tables) -> DataFrame:
    """Three scopes of variables per brand; a numeric override takes no part."""

    def scope(df: DataFrame, value) -> DataFrame:
        return df.groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("name")).agg(
            value.alias("value"), F.min("p_partkey").alias("position")
        )

    numbers = scope(t.part, F.max("p_size"))
    scopes = [
        scope(t.part, F.max(F.lit("default"))),
        scope(t.part.filter("p_size >= 25"), F.max("p_type")),
        scope(t.part.filter("p_type = 'PROMO'"), F.max(F.lit("local"))),
        numbers,
    ]
    merged = layered_merge(scopes, by=["grp"])
    return merged.select(
        "grp", "name", "value",
        F.col("position.scope").alias("first_scope"), F.col("position.position").alias("first_position"),
    )


def _bucketed(t: Tables, df: DataFrame, label: str, key: str) -> DataFrame:
    path = scratch_path(t.spark, f"bucketed-{label}")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write_table(df, table, path=path, bucket_by=[key], buckets=8)
    return t.spark.table(table)


@query(
    """SELECT l_orderkey, l_linenumber, o_orderpriority, coalesce(o_totalprice, 0) AS o_totalprice
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""
)
def enrich_bucketed_lineitem(t: Tables) -> DataFrame:
    """Lines with their order's columns, both bucketed by order; hot orders alone are dealt anew."""
    lines = _bucketed(t, t.lineitem.select("l_orderkey", "l_linenumber"), "lines", "l_orderkey")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_totalprice")
    side = _bucketed(t, orders, "orders", "l_orderkey")
    return left_enrich(lines, side, "l_orderkey", fill={"o_totalprice": 0}, join=sketched_join)


@query(
    """WITH s AS (SELECT source, CAST(count(*) AS BIGINT) AS source_docs, max(n_chars) AS longest FROM documents GROUP BY 1)
SELECT doc_id, d.source, source_docs, longest FROM documents d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
)
def enrich_hot_sources(t: Tables) -> DataFrame:
    """Documents with figures of their source, where a few sources hold most rows."""
    docs = t.documents
    side = docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.max("n_chars").alias("longest"))
    return left_enrich(docs.select("doc_id", "source"), side, "source", null_safe=True, join=sketched_join)


@query(
    """SELECT e.event_id, e.user_id, (SELECT max_by(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = e.user_id) AS last_priority
FROM events e"""
)
def lookup_last_of_hot_users(t: Tables) -> DataFrame:
    """Events with the priority of the latest order of the customer of that number."""
    orders = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderpriority", "o_orderkey")
    events = t.events.select("event_id", "user_id")
    return lookup_last(events, orders, "user_id", "o_orderpriority", "o_orderkey", out="last_priority", join=sketched_join)
