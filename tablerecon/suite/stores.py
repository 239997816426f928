"""The versioned store: deltas and compaction, late rows, several writers, drift by hash sums, deep JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.errors import StalePlanError
from tablerecon.functions.documents import parse
from tablerecon.plans import TableStore, apply_changes, diff_fields, plan
from tablerecon.session import materialize, scratch_path
from tablerecon.streaming import apply_batch
from tablerecon.suite.pairs import MONEY, ORDERS_PAIR, orders_live, orders_state
from tablerecon.suite.registry import Tables, query


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


THEN, NOW = "2024-01-01 00:00:00", "2024-06-01 00:00:00"


def _store(t: Tables, key: str, **options) -> TableStore:
    return TableStore(t.spark, scratch_path(t.spark, "store"), key, **options)


@query(
    """WITH typed AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events
  WHERE event_id % 7 <> 0 GROUP BY 1),
valued AS (SELECT user_id, CAST(arg_max(CAST(value AS DECIMAL(18,2)), event_id) AS VARCHAR) AS value FROM events GROUP BY 1),
users AS (SELECT DISTINCT user_id FROM events)
SELECT coalesce(c_custkey, u.user_id) AS user_id,
  CASE WHEN typed.event_type IS NOT NULL THEN typed.event_type WHEN c_custkey IS NOT NULL THEN 'none' END AS event_type,
  valued.value
FROM customer FULL JOIN users u ON u.user_id = c_custkey
LEFT JOIN typed ON typed.user_id = u.user_id LEFT JOIN valued ON valued.user_id = u.user_id"""
)
def stream_apply_out_of_order(t: Tables) -> DataFrame:
    """Events in batches that come newest first; every seventh says nothing of its type.

    Per user and column the highest event id counts, whichever batch brought it.
    """
    store = _store(t, "user_id", share=0.5)
    store.create(t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type")), _stamp(THEN))
    named = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    value = F.col("value").cast(MONEY).cast("string")
    rows = t.events.select("user_id", named.alias("event_type"), value.alias("value"), "event_id")
    last = t.events.agg(F.max("event_id")).first()[0]
    batch = F.col("event_id") * 4 > (0 if last is None else last)
    halves = (rows.filter(batch & (F.col("event_id") % 2 == 0)), rows.filter(~batch), rows.filter(batch & (F.col("event_id") % 2 == 1)))
    for i, half in enumerate(halves):
        apply_batch(store, half, f"late-{i}", "event_id", _stamp(NOW))
    return store.read().select("user_id", "event_type", "value")


@query(
    """WITH one AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN 'ONE' ELSE c_mktsegment END AS seg
  FROM customer),
two AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'TWO' ELSE seg END AS seg FROM one WHERE c_custkey % 9 <> 0)
SELECT c_custkey, c_name, CASE WHEN c_custkey % 100 = 1 THEN 'THREE' ELSE seg END AS seg FROM two
UNION ALL SELECT c_custkey, c_name, 'BACK' FROM customer WHERE c_custkey % 900 = 0"""
)
def apply_delta_compacted(t: Tables) -> DataFrame:
    """Applies of a few rows stay deltas, one of half the rows has the parts written anew, then
    deltas again: deletes, updates and a return of deleted keys."""
    store = _store(t, "c_custkey")
    rows = t.customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    store.create(rows, _stamp(THEN))
    key = F.col("c_custkey")
    few = rows.filter(key % 50 == 0).withColumn("seg", F.lit("ONE"))
    store.apply(store.plan(few, deletes=False), _stamp(NOW))
    now = store.read().select("c_custkey", "c_name", "seg").filter(key % 9 != 0)
    half = now.withColumn("seg", F.when(key % 2 == 0, "TWO").otherwise(F.col("seg")))
    store.apply(store.plan(half), _stamp(NOW))
    store.apply(store.plan(now.filter(key % 100 == 1).withColumn("seg", F.lit("THREE")), deletes=False), _stamp(NOW))
    back = rows.filter(key % 900 == 0).withColumn("seg", F.lit("BACK"))
    store.apply(store.plan(back, deletes=False), _stamp(NOW))
    return store.read().select("c_custkey", "c_name", "seg")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE o_orderstatus END AS status
FROM orders"""
)
def apply_parts_split(t: Tables) -> DataFrame:
    """A table that starts with a third of the orders and splits its parts as the rest joins."""
    store = _store(t, "o_orderkey", parts=2, part_rows=1_000)
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    key = F.col("o_orderkey")
    store.create(rows.filter(key % 3 == 2), _stamp(THEN))
    for rest, status in ((0, "A"), (1, "B")):
        more = rows.filter(key % 3 == rest).withColumn("status", F.lit(status))
        store.apply(store.plan(more, deletes=False), _stamp(NOW))
    return store.read().select("o_orderkey", "status")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'first'
  ELSE c_mktsegment END AS seg, CAST(2 AS BIGINT) AS landed, CAST(1 AS BIGINT) AS refused FROM customer
  WHERE c_custkey <> (SELECT min(c_custkey) FROM customer)
UNION ALL SELECT min(c_custkey), 'first', 2, 1 FROM customer"""
)
def apply_of_three_writers(t: Tables) -> DataFrame:
    """Three plans against one version: two on other parts land, one on a part that was written is refused."""
    store = _store(t, "c_custkey")
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"))
    at = store.create(rows, _stamp(THEN))
    part = store._part(at.modulus, at.split)
    first = rows.agg(F.min("c_custkey").alias("c_custkey")).withColumn("seg", F.lit("first"))
    own = first.select(part.alias("p")).first()["p"]
    other = rows.filter(part != own).agg(F.max("c_custkey").alias("c_custkey")).withColumn("seg", F.lit("other"))
    plans = [store.plan(x, deletes=False) for x in (first, other, first.withColumn("seg", F.lit("late")))]
    refused = 0
    for made in plans:
        try:
            store.apply(made, _stamp(NOW), rebase=True)
        except StalePlanError:
            refused += 1
    landed = store.require().serial
    undo = rows.join(other.select("c_custkey"), "c_custkey", "left_semi")
    store.apply(store.plan(undo, deletes=False), _stamp(NOW))
    return store.read().select("c_custkey", "seg", F.lit(landed).alias("landed"), F.lit(refused).cast("long").alias("refused"))


@query(
    f"""WITH {ORDERS_PAIR},
after AS (SELECT s.o_orderkey, l.o_totalprice, l.o_orderpriority,
  l.o_totalprice <> s.o_totalprice OR l.o_orderpriority <> s.o_orderpriority AS moved
  FROM state s JOIN live l USING (o_orderkey))
SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderpriority,
  CAST(moved AS INTEGER) AS moved, CAST(0 AS BIGINT) AS still_differing FROM after"""
)
def refresh_by_part_sums(t: Tables) -> DataFrame:
    """A refresh that reads the parts whose hash sums differ from the live table's; afterwards none does."""
    store = _store(t, "o_orderkey")
    store.create(orders_state(t))
    live = orders_live(t)
    store.refresh(live, _stamp(NOW))
    left = len(store.differing_parts(live))
    moved = (F.col("updated_at") == _stamp(NOW)).cast("int")
    return store.read().select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderpriority",
        moved.alias("moved"), F.lit(left).cast("long").alias("still_differing"),
    )


def _deep(df: DataFrame, leaf: Column) -> Column:
    """``leaf`` below 1 to 40 objects, by event id."""
    depth = (F.col("event_id") % 40 + 1).cast("int")
    return F.concat(F.expr("repeat('{\"a\":', int(event_id % 40 + 1))"), leaf, F.repeat(F.lit("}"), depth))


def _documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.get_json_object("props", "$.k")
    want = F.concat(F.lit('{"k":'), k, F.lit("}"))
    third = F.when(F.col("event_id") % 3 == 0, F.lit("-1")).otherwise(k)
    have = F.concat(F.lit('{"k":'), third, F.lit(',"z":{"y":1}}'))
    side = lambda leaf: t.events.select("event_id", parse(_deep(t.events, leaf)).alias("doc"))
    return side(want), side(have)


DEEP = """opened AS (SELECT event_id, repeat('{"a":', CAST(event_id % 40 + 1 AS INTEGER)) AS l, repeat('}', CAST(event_id % 40 + 1 AS INTEGER)) AS r,
  json_extract_string(props, '$.k') AS k FROM events)"""


@query(
    f"""WITH {DEEP}
SELECT event_id, 'doc' AS field, l || '{{"k":-1,"z":{{"y":1}}}}' || r AS "from", l || '{{"k":' || k || '}}' || r AS "to"
FROM opened WHERE event_id % 3 = 0 AND CAST(k AS BIGINT) <> -1"""
)
def diff_json_any_depth(t: Tables) -> DataFrame:
    """Documents of up to 41 levels compared in part: a member only the stored one has does not count."""
    desired, prior = _documents(t)
    return diff_fields(plan(desired, prior, "event_id"), "event_id")


@query(
    f"""WITH {DEEP}
SELECT event_id, l || '{{"k":' || k || ',"z":{{"y":1}}}}' || r AS doc FROM opened"""
)
def apply_json_any_depth(t: Tables) -> DataFrame:
    """The same documents applied: what the desired one holds is laid over the stored one, at every level."""
    desired, prior = _documents(t)
    after = apply_changes(prior, materialize(plan(desired, prior, "event_id"), "changes"), "event_id")
    return after.select("event_id", F.to_json("doc").alias("doc"))
