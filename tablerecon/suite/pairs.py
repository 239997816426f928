"""Desired and prior sides derived from the given tables.

Each side is a whole table under a business rule, in Spark and in SQL: the rule
decides which rows are created, deleted or updated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.suite.registry import Tables

MONEY = "decimal(18,2)"


def customer_desired(t: Tables) -> DataFrame:
    """Customers in good standing."""
    return t.customer.filter("c_acctbal >= 0").select(
        "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast(MONEY).alias("c_acctbal"), "c_mktsegment"
    )


def customer_prior(t: Tables) -> DataFrame:
    """An older copy: without one segment, with another's old label and old balances."""
    machinery = F.col("c_mktsegment") == "MACHINERY"
    label = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "AUTO").otherwise(F.col("c_mktsegment"))
    balance = F.col("c_acctbal").cast(MONEY) + F.when(machinery, 1).otherwise(0)
    return t.customer.filter("c_mktsegment <> 'FURNITURE'").select(
        "c_custkey", "c_name", "c_nationkey", balance.cast(MONEY).alias("c_acctbal"), label.alias("c_mktsegment")
    )


CUSTOMER_PAIR = """
desired AS (
  SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment
  FROM customer WHERE c_acctbal >= 0),
prior AS (
  SELECT c_custkey, c_name, c_nationkey,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END
              AS DECIMAL(18,2)) AS c_acctbal,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTO' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_mktsegment <> 'FURNITURE')"""

CUSTOMER_CHANGES = (
    CUSTOMER_PAIR
    + """,
changes AS (
  SELECT coalesce(d.c_custkey, p.c_custkey) AS c_custkey,
         CASE WHEN p.c_custkey IS NULL THEN 'create'
              WHEN d.c_custkey IS NULL THEN 'delete'
              WHEN d.c_name IS DISTINCT FROM p.c_name OR d.c_nationkey IS DISTINCT FROM p.c_nationkey
                OR d.c_acctbal IS DISTINCT FROM p.c_acctbal OR d.c_mktsegment IS DISTINCT FROM p.c_mktsegment
              THEN 'update' ELSE 'no-op' END AS action,
         d.c_name AS d_name, d.c_nationkey AS d_nationkey, d.c_acctbal AS d_acctbal, d.c_mktsegment AS d_mktsegment,
         p.c_name AS p_name, p.c_nationkey AS p_nationkey, p.c_acctbal AS p_acctbal, p.c_mktsegment AS p_mktsegment
  FROM desired d FULL JOIN prior p ON d.c_custkey = p.c_custkey)"""
)


def orders_state(t: Tables) -> DataFrame:
    """Stored orders, as attributes with both timestamps."""
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.col("o_totalprice").cast(MONEY).alias("o_totalprice"),
        "o_orderpriority",
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def orders_live(t: Tables) -> DataFrame:
    """Live orders: finished ones are archived, urgent ones cost more."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    price = F.col("o_totalprice").cast(MONEY) + F.when(urgent, 10).otherwise(0)
    return t.orders.filter("o_orderstatus <> 'F'").select(
        "o_orderkey", "o_custkey", "o_orderstatus", price.cast(MONEY).alias("o_totalprice"),
        F.when(urgent, "1-HIGHEST").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_PAIR = """
state AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderpriority,
         o_orderdate AS created_at, o_orderdate AS updated_at FROM orders),
live AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderpriority = '1-URGENT' THEN 10 ELSE 0 END
              AS DECIMAL(18,2)) AS o_totalprice,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '1-HIGHEST' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderstatus <> 'F')"""


def lineitem_keyed(df: DataFrame) -> DataFrame:
    """Line items summed to their (order, line) key."""
    return df.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("price"),
        F.max("l_linestatus").alias("linestatus"),
    )


def lineitem_desired(t: Tables) -> DataFrame:
    return lineitem_keyed(t.lineitem.filter("l_returnflag <> 'R'"))


def lineitem_prior(t: Tables) -> DataFrame:
    return lineitem_keyed(t.lineitem.filter("l_shipdate < TIMESTAMP_NTZ '2000-01-01 00:00:00'"))


def _keyed_sql(where: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS price, max(l_linestatus) AS linestatus
  FROM lineitem WHERE {where} GROUP BY 1, 2"""


LINEITEM_PAIR = f"""
desired AS ({_keyed_sql("l_returnflag <> 'R'")}),
prior AS ({_keyed_sql("l_shipdate < TIMESTAMP '2000-01-01 00:00:00'")})"""
