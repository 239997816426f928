"""Data-quality checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.operators import checks as C
from tablerecon.suite.registry import Tables, query


@query(
    """SELECT 'pattern' AS "check", CAST(o_orderkey AS VARCHAR) AS key,
  'o_orderpriority does not match: ' || o_orderpriority AS message
FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')"""
)
def check_pattern_names(t: Tables) -> DataFrame:
    return C.check_pattern(t.orders, "o_orderpriority", "^[0-9]-[A-Z]+$", "o_orderkey")


@query(
    """SELECT 'lines' AS "check", CAST(doc_id AS VARCHAR) AS key, 'lines has an empty element' AS message
FROM documents WHERE list_contains(string_split(text, chr(10)), '')
UNION ALL SELECT 'segment', CAST(c_custkey AS VARCHAR), 'c_mktsegment is empty' FROM customer
WHERE c_mktsegment = 'BUILDING'"""
)
def check_non_empty(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    customers = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return C.violations(
        C.check_non_empty(docs, "lines", "doc_id", "lines"),
        C.check_non_empty(customers, "c_mktsegment", "c_custkey", "segment"),
    )


@query(
    """SELECT 'in_set' AS "check", CAST(o_orderkey AS VARCHAR) AS key, 'o_orderstatus not allowed: ' || o_orderstatus
  AS message FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"""
)
def check_in_set_status(t: Tables) -> DataFrame:
    return C.check_in_set(t.orders, "o_orderstatus", ["O", "F"], "o_orderkey")


@query(
    """SELECT 'implies' AS "check", l_orderkey || '|' || l_linenumber AS key, 'returned lines are closed' AS message
FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'"""
)
def check_implies_lineitem(t: Tables) -> DataFrame:
    return C.check_implies(
        t.lineitem,
        F.col("l_returnflag") == "R",
        F.col("l_linestatus") == "F",
        ["l_orderkey", "l_linenumber"],
        "returned lines are closed",
    )


@query(
    """WITH p AS (SELECT p_partkey, nullif(p_type, 'PROMO') AS "table", CASE WHEN p_size > 25 THEN p_name END AS query
  FROM part)
SELECT 'mode' AS "check", CAST(p_partkey AS VARCHAR) AS key, 'not both table and query' AS message FROM p
WHERE "table" IS NOT NULL AND query IS NOT NULL
UNION ALL SELECT 'mode', CAST(p_partkey AS VARCHAR), 'one of table and query' FROM p
WHERE ("table" IS NULL) = (query IS NULL)"""
)
def check_modes_part(t: Tables) -> DataFrame:
    """Mutual exclusion and exactly-one-of, both in one pass."""
    rows = t.part.select(
        "p_partkey",
        F.nullif("p_type", F.lit("PROMO")).alias("table"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("query"),
    )
    flags = {
        "not both table and query": C.exclusive("table", "query"),
        "one of table and query": C.exactly_one("table", "query"),
    }
    return C.check_flags(rows, flags, "p_partkey", "mode")


@query(
    """SELECT 'unique' AS "check", l_orderkey || '|' || l_linenumber AS key, 'rows: ' || count(*) AS message
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def check_unique_lineitem(t: Tables) -> DataFrame:
    return C.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    """WITH d AS (SELECT doc_id, lang, sha256(text) AS name, min(doc_id) OVER (PARTITION BY lang, text) AS first_id
  FROM documents)
SELECT 'unique_in_group' AS "check", CAST(doc_id AS VARCHAR) AS key,
  'duplicate ' || lang || ' name ''' || name || ''': first held by ' || first_id AS message
FROM d WHERE doc_id > first_id"""
)
def dup_in_group_documents(t: Tables) -> DataFrame:
    """Exact copies of whole texts within a language name the first holder."""
    named = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("name"))
    return C.check_unique_in_group(named, "lang", "name", "doc_id", "doc_id")


@query(
    """SELECT 'reference' AS "check", l_orderkey || '|' || l_linenumber AS key,
  'unknown reference: ' || l_partkey AS message
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_size < 40)"""
)
def orphan_lineitem_parts(t: Tables) -> DataFrame:
    """References that neither of two tables holds."""
    desired = t.part.filter("p_type = 'PROMO'")
    stored = t.part.filter("p_size < 40")
    return C.check_reference(
        t.lineitem, "l_partkey", [desired, stored], "p_partkey", ["l_orderkey", "l_linenumber"]
    )


@query(
    """WITH deps AS (SELECT conv_id, turn, unnest([conv_id || ':' || (turn - 1), conv_id || ':' || (turn - 2)]) AS dep
  FROM conversations)
SELECT 'depends_on' AS "check", conv_id || '|' || turn AS key, 'unknown reference: ' || dep AS message
FROM deps WHERE dep NOT IN (SELECT conv_id || ':' || turn FROM conversations)"""
)
def orphan_conversation_turns(t: Tables) -> DataFrame:
    """Dependency lists whose members do not exist."""
    node = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    dep = [F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - n).cast("string")) for n in (1, 2)]
    rows = t.conversations.select("conv_id", "turn", node.alias("node"), F.array(*dep).alias("depends_on"))
    return C.check_reference(rows, "depends_on", rows, "node", ["conv_id", "turn"], "depends_on")


@query(
    """SELECT 'asian' AS "check", CAST(c_custkey AS VARCHAR) AS key, 'unknown reference: ' || c_nationkey AS message
FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA')
UNION ALL SELECT 'suffix', CAST(c_custkey AS VARCHAR), 'unknown reference: ' || c_nationkey
FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name LIKE '%ICA')"""
)
def typed_ref_nation(t: Tables) -> DataFrame:
    """A customer's nation must exist as a given type, or as a type suffix."""
    view = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    asian = C.check_typed_reference(
        t.customer, "c_nationkey", view, "n_nationkey", "r_name", "c_custkey", type_is="ASIA", check="asian"
    )
    suffix = C.check_typed_reference(
        t.customer, "c_nationkey", view, "n_nationkey", "r_name", "c_custkey", type_suffix="ICA", check="suffix"
    )
    return C.violations(asian, suffix)


@query(
    """SELECT 'any_member' AS "check", CAST(o_orderkey AS VARCHAR) AS key, 'no line of 40 pieces' AS message
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)"""
)
def orders_without_big_item(t: Tables) -> DataFrame:
    members = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return C.check_any_member(
        members, "o_orderkey", F.col("l_quantity") >= 40, "no line of 40 pieces", owners=t.orders
    )


@query(
    """SELECT 'functional_dependency' AS "check", p_name AS key,
  'conflicting values: ' || min(p_brand) || ' vs ' || max(p_brand) AS message
FROM part GROUP BY p_name HAVING min(p_brand) <> max(p_brand)"""
)
def alias_conflict(t: Tables) -> DataFrame:
    return C.check_functional_dependency(t.part, "p_name", "p_brand")


@query(
    """SELECT 'not_self' AS "check", l_orderkey || '|' || l_partkey AS key,
  'l_suppkey includes own id ' || l_partkey AS message FROM lineitem WHERE l_partkey = l_suppkey
UNION ALL SELECT 'not_self_list', l_orderkey || '|' || l_partkey, 'targets includes own id ' || l_partkey
FROM lineitem WHERE l_partkey IN (l_suppkey, l_linenumber)"""
)
def self_reference(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey"]
    lists = t.lineitem.withColumn("targets", F.array("l_suppkey", F.col("l_linenumber").cast("long")))
    return C.violations(
        C.check_not_self(t.lineitem, "l_partkey", "l_suppkey", keys),
        C.check_not_self(lists, "l_partkey", "targets", keys, "not_self_list"),
    )


@query(
    """WITH objects AS (SELECT p_partkey AS l_partkey FROM part WHERE p_size < 40),
rules AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity >= 45),
ok AS (SELECT DISTINCT l_partkey, l_returnflag FROM rules WHERE l_partkey IN (SELECT l_partkey FROM objects))
SELECT 'granted' AS "check", l_orderkey || '|' || l_linenumber AS key,
  'missing or not shared: ' || l_partkey || ' to ' || l_returnflag AS message
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.l_partkey = l.l_partkey AND ok.l_returnflag = l.l_returnflag)"""
)
def granted_refs(t: Tables) -> DataFrame:
    """A line may use a part only if it exists and is shared with its flag."""
    objects = t.part.filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    rules = t.lineitem.filter("l_quantity >= 45").select("l_partkey", "l_returnflag")
    return C.check_granted(
        t.lineitem, objects, rules, ["l_orderkey", "l_linenumber"], ["l_partkey"], "l_returnflag"
    )


@query(
    """SELECT 'in_registry' AS "check", CAST(doc_id AS VARCHAR) AS key, 'unknown reference: ' || doc_id AS message
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def registry_kind_check(t: Tables) -> DataFrame:
    """Documents without an entry of the given kind in the label registry."""
    return C.check_in_registry(t.documents, "doc_id", t.labels, "doc_id", "quality", 1, "doc_id")
