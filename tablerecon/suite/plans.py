"""Plan, diff, drift, refresh and apply over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.documents import parse
from tablerecon.operators.checks import check_keys
from tablerecon.plans import (
    TableStore,
    actionable,
    apply_changes,
    check_plan,
    diff_fields,
    drift,
    load_plan,
    next_serial,
    plan,
    plan_destroy,
    refresh,
    save_plan,
    snapshot_of,
    summary,
    summary_actionable,
)
from tablerecon.plans.apply import with_timestamps
from tablerecon.plans.changes import plan_upserts
from tablerecon.session import materialize, scratch_path
from tablerecon.sources import write_table
from tablerecon.suite.pairs import (
    CUSTOMER_CHANGES,
    CUSTOMER_PAIR,
    LINEITEM_PAIR,
    ORDERS_PAIR,
    customer_desired,
    customer_prior,
    lineitem_desired,
    lineitem_prior,
    orders_live,
    orders_state,
)
from tablerecon.suite.registry import Tables, query

KEY = "c_custkey"
THEN = "2024-01-01 00:00:00"
NOW = "2024-06-01 00:00:00"


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _changed(col: str = "changed_fields") -> Column:
    return F.array_join(col, ",").alias("changed")


def _customer_plan(t: Tables, **options) -> DataFrame:
    return plan(customer_desired(t), customer_prior(t), KEY, **options)


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT c_custkey, action,
       CASE WHEN action = 'update' THEN concat_ws(',',
         CASE WHEN d_name IS DISTINCT FROM p_name THEN 'c_name' END,
         CASE WHEN d_nationkey IS DISTINCT FROM p_nationkey THEN 'c_nationkey' END,
         CASE WHEN d_acctbal IS DISTINCT FROM p_acctbal THEN 'c_acctbal' END,
         CASE WHEN d_mktsegment IS DISTINCT FROM p_mktsegment THEN 'c_mktsegment' END) ELSE '' END AS changed
FROM changes"""
)
def table_plan(t: Tables) -> DataFrame:
    return _customer_plan(t).select(KEY, "action", _changed())


@query(
    f"""WITH {LINEITEM_PAIR}
SELECT coalesce(d.l_orderkey, p.l_orderkey) AS l_orderkey, coalesce(d.l_linenumber, p.l_linenumber) AS l_linenumber,
       CASE WHEN p.l_orderkey IS NULL THEN 'create' WHEN d.l_orderkey IS NULL THEN 'delete'
            WHEN d.quantity <> p.quantity OR d.price <> p.price OR d.linestatus <> p.linestatus THEN 'update'
            ELSE 'no-op' END AS action
FROM desired d FULL JOIN prior p ON d.l_orderkey = p.l_orderkey AND d.l_linenumber = p.l_linenumber"""
)
def table_plan_lineitem(t: Tables) -> DataFrame:
    changes = plan(lineitem_desired(t), lineitem_prior(t), ["l_orderkey", "l_linenumber"])
    return changes.select("l_orderkey", "l_linenumber", "action")


@query(
    f"""WITH {ORDERS_PAIR}
SELECT coalesce(s.o_orderkey, l.o_orderkey) AS o_orderkey,
       CASE WHEN s.o_orderkey IS NULL THEN 'create' WHEN l.o_orderkey IS NULL THEN 'delete'
            WHEN l.o_totalprice <> s.o_totalprice OR l.o_orderpriority <> s.o_orderpriority THEN 'update'
            ELSE 'no-op' END AS action
FROM state s FULL JOIN live l ON s.o_orderkey = l.o_orderkey"""
)
def table_plan_orders(t: Tables) -> DataFrame:
    return plan(orders_live(t), orders_state(t), "o_orderkey").select("o_orderkey", "action")


@query(
    f"""WITH {ORDERS_PAIR}
SELECT coalesce(s.o_orderkey, l.o_orderkey) AS o_orderkey,
       CASE WHEN s.o_orderkey IS NULL THEN 'create' WHEN l.o_orderkey IS NULL THEN 'delete'
            WHEN l.o_totalprice <> s.o_totalprice OR l.o_orderpriority <> s.o_orderpriority THEN 'update'
            ELSE 'no-op' END AS action
FROM state s FULL JOIN live l ON s.o_orderkey = l.o_orderkey"""
)
def bucketed_plan_orders(t: Tables) -> DataFrame:
    """Both sides as tables bucketed by key: the plan's join needs no shuffle."""
    sides = []
    for label, df in (("live", orders_live(t)), ("state", orders_state(t))):
        path = scratch_path(t.spark, f"bucketed-{label}")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        write_table(df, table, path=path, bucket_by=["o_orderkey"], buckets=8)
        sides.append(t.spark.table(table))
    return plan(*sides, "o_orderkey").select("o_orderkey", "action")


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT a.action, CAST(count(c.c_custkey) AS BIGINT) AS rows
FROM (VALUES ('create'), ('update'), ('delete'), ('no-op')) a(action)
LEFT JOIN changes c ON c.action = a.action GROUP BY 1"""
)
def plan_summary(t: Tables) -> DataFrame:
    return summary(_customer_plan(t))


@query(
    """SELECT a.action, CAST(count(o.o_orderkey) AS BIGINT) AS rows
FROM (VALUES ('create'), ('update'), ('delete')) a(action)
LEFT JOIN orders o ON a.action = 'create' GROUP BY 1"""
)
def change_summary(t: Tables) -> DataFrame:
    """Orders against an empty table: only creates, the rest zero-filled."""
    nothing = t.orders.filter(F.lit(False))
    return summary_actionable(plan(t.orders, nothing, "o_orderkey"))


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT c_custkey, field, old AS "from", new AS "to" FROM (
  SELECT c_custkey, 'c_name' AS field, p_name AS old, d_name AS new, d_name IS DISTINCT FROM p_name AS hit
    FROM changes WHERE action = 'update'
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(p_nationkey AS VARCHAR), CAST(d_nationkey AS VARCHAR),
    d_nationkey IS DISTINCT FROM p_nationkey FROM changes WHERE action = 'update'
  UNION ALL SELECT c_custkey, 'c_acctbal', CAST(p_acctbal AS VARCHAR), CAST(d_acctbal AS VARCHAR),
    d_acctbal IS DISTINCT FROM p_acctbal FROM changes WHERE action = 'update'
  UNION ALL SELECT c_custkey, 'c_mktsegment', p_mktsegment, d_mktsegment,
    d_mktsegment IS DISTINCT FROM p_mktsegment FROM changes WHERE action = 'update') WHERE hit"""
)
def diff_long(t: Tables) -> DataFrame:
    return diff_fields(_customer_plan(t), KEY)


def _event_map(*, extra: Column | None = None, k: Column | None = None) -> Column:
    key = F.get_json_object("props", "$.k") if k is None else k
    base = F.create_map(F.lit("k"), key, F.lit("type"), F.col("event_type"))
    if extra is None:
        return base
    return F.when(extra, F.map_concat(base, F.create_map(F.lit("user"), F.col("user_id").cast("string")))).otherwise(
        base
    )


def _event_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Declared maps, and stored ones with extra user keys and other error codes."""
    code = F.get_json_object("props", "$.k")
    off = F.when(F.col("event_type") == "error", F.concat(code, F.lit("!"))).otherwise(code)
    desired = t.events.select("event_id", _event_map().alias("attrs"))
    stored = _event_map(extra=F.col("event_type").isin("click", "view"), k=off)
    return desired, t.events.select("event_id", stored.alias("attrs"))


EVENT_SIDES = """
d AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
p AS (SELECT event_id, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') || '!'
      ELSE json_extract_string(props, '$.k') END AS k, event_type,
      CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS VARCHAR) END AS extra FROM events)"""


@query(
    f"""WITH {EVENT_SIDES}
SELECT d.event_id, CASE WHEN d.k IS DISTINCT FROM p.k OR d.event_type IS DISTINCT FROM p.event_type
  OR p.extra IS NOT NULL THEN 'update' ELSE 'no-op' END AS action FROM d JOIN p USING (event_id)"""
)
def diff_exact(t: Tables) -> DataFrame:
    """Maps compared exactly: an extra stored key is a difference."""
    desired, prior = _event_sides(t)
    return plan(desired, prior, "event_id", {"attrs": "exact"}).select("event_id", "action")


@query(
    f"""WITH {EVENT_SIDES}
SELECT d.event_id, CASE WHEN d.k IS DISTINCT FROM p.k OR d.event_type IS DISTINCT FROM p.event_type
  THEN 'update' ELSE 'no-op' END AS action FROM d JOIN p USING (event_id)"""
)
def diff_partial_map(t: Tables) -> DataFrame:
    """Maps compared partially: extra stored keys do not count."""
    desired, prior = _event_sides(t)
    return plan(desired, prior, "event_id").select("event_id", "action")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'update' ELSE 'no-op' END AS action
FROM events"""
)
def diff_partial_struct(t: Tables) -> DataFrame:
    """Nested structs: stored extras are ignored at every level, lists compare strictly."""
    user = F.col("user_id")
    desired = t.events.select(
        "event_id",
        F.struct(
            F.struct(F.col("event_type").alias("kind")).alias("inner"),
            F.array(user, user + 1).alias("window"),
        ).alias("attrs"),
    )
    kind = F.when(F.col("event_type") == "error", "failure").otherwise(F.col("event_type"))
    swapped = F.when(F.col("event_type") == "signup", F.array(user + 1, user)).otherwise(F.array(user, user + 1))
    prior = t.events.select(
        "event_id",
        F.struct(
            F.struct(kind.alias("kind"), user.alias("extra")).alias("inner"),
            swapped.alias("window"),
            F.col("value").alias("value"),
        ).alias("attrs"),
    )
    return plan(desired, prior, "event_id").select("event_id", "action")


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'update' ELSE 'no-op' END AS action FROM events"""
)
def diff_partial_json(t: Tables) -> DataFrame:
    """JSON documents: only what the desired document holds is compared, at any level."""
    kind = F.col("event_type")
    inner = F.concat(F.lit('{"n":{"type":"'), kind, F.lit('"}}'))
    stored_kind = F.when(kind == "purchase", "sale").otherwise(kind)
    stored = F.concat(
        F.lit('{"z":1,"n":{"z":'), F.col("user_id").cast("string"), F.lit(',"type":"'), stored_kind, F.lit('"}}')
    )
    desired = t.events.select("event_id", parse(inner).alias("attrs"))
    prior = t.events.select("event_id", parse(stored).alias("attrs"))
    return plan(desired, prior, "event_id").select("event_id", "action")


@query(
    """SELECT doc_id, CASE WHEN list_sort(list_distinct([lang, source]))
  <> list_sort(list_distinct([source, CASE WHEN lang = 'fr' THEN 'fra' ELSE lang END, source]))
  THEN 'update' ELSE 'no-op' END AS action FROM documents"""
)
def diff_set(t: Tables) -> DataFrame:
    """Tag lists compared as sets."""
    lang = F.when(F.col("lang") == "fr", "fra").otherwise(F.col("lang"))
    desired = t.documents.select("doc_id", F.array("lang", "source").alias("tags"))
    prior = t.documents.select("doc_id", F.array(F.col("source"), lang, F.col("source")).alias("tags"))
    return plan(desired, prior, "doc_id", {"tags": "set"}).select("doc_id", "action")


@query(
    f"""WITH {CUSTOMER_PAIR},
asked AS (SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN c_acctbal END AS c_acctbal,
          nullif(c_mktsegment, 'AUTOMOBILE') AS c_mktsegment FROM desired)
SELECT coalesce(d.c_custkey, p.c_custkey) AS c_custkey,
       CASE WHEN p.c_custkey IS NULL THEN 'create' WHEN d.c_custkey IS NULL THEN 'delete'
            WHEN (d.c_acctbal IS NOT NULL AND d.c_acctbal IS DISTINCT FROM p.c_acctbal)
              OR (d.c_mktsegment IS NOT NULL AND d.c_mktsegment IS DISTINCT FROM p.c_mktsegment)
            THEN 'update' ELSE 'no-op' END AS action
FROM asked d FULL JOIN prior p ON d.c_custkey = p.c_custkey"""
)
def plan_unmanaged_nulls(t: Tables) -> DataFrame:
    """A null desired value is not managed: it never causes an update."""
    asked = customer_desired(t).select(
        KEY,
        F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("AUTOMOBILE")).alias("c_mktsegment"),
    )
    return plan(asked, customer_prior(t), KEY).select(KEY, "action")


VARS = [("projectKey", "PRJ_${zone}"), ("zone", "EU")]


@query(
    """WITH d AS (SELECT p_partkey, replace(replace('${projectKey}/' || p_brand || '/${zone}',
    '${projectKey}', 'PRJ_${zone}'), '${zone}', 'EU') AS path FROM part),
p AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'PRJ_US/' ELSE 'PRJ_EU/' END || p_brand || '/EU' AS path
      FROM part)
SELECT p_partkey, CASE WHEN d.path <> p.path THEN 'update' ELSE 'no-op' END AS action,
       '${projectKey}/' || p_brand || '/${zone}' AS desired_path, d.path AS planned_path
FROM d JOIN p USING (p_partkey) JOIN part USING (p_partkey)"""
)
def plan_with_vars(t: Tables) -> DataFrame:
    """Templates are resolved before comparing; the raw text is kept beside."""
    desired = t.part.select("p_partkey", F.concat(F.lit("${projectKey}/"), "p_brand", F.lit("/${zone}")).alias("path"))
    home = F.when(F.col("p_type") == "PROMO", "PRJ_US/").otherwise("PRJ_EU/")
    prior = t.part.select("p_partkey", F.concat(home, "p_brand", F.lit("/EU")).alias("path"))
    changes = plan(desired, prior, "p_partkey", variables=VARS)
    return changes.select(
        "p_partkey",
        "action",
        F.col("desired.path").alias("desired_path"),
        F.col("planned.path").alias("planned_path"),
    )


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT c_custkey, CASE WHEN action = 'update' AND d_acctbal IS NOT DISTINCT FROM p_acctbal THEN 'no-op'
  ELSE action END AS action FROM changes"""
)
def plan_ignore(t: Tables) -> DataFrame:
    """An ignored column is carried along but never causes an update."""
    return _customer_plan(t, ignore=["c_mktsegment"]).select(KEY, "action")


@query(
    f"""WITH {CUSTOMER_CHANGES} SELECT c_custkey, action FROM changes WHERE action <> 'delete'"""
)
def plan_upserts_customer(t: Tables) -> DataFrame:
    return plan_upserts(customer_desired(t), customer_prior(t), KEY).select(KEY, "action")


@query(f"WITH {CUSTOMER_PAIR} SELECT c_custkey, 'delete' AS action, c_name AS prior_name FROM prior", "plan_destroy")
def _plan_destroy(t: Tables) -> DataFrame:
    return plan_destroy(customer_prior(t), KEY).select(KEY, "action", F.col("prior.c_name").alias("prior_name"))


APPLIED_COLUMNS = """c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment,
  created_at, updated_at"""

APPLIED = f"""WITH {CUSTOMER_CHANGES},
after AS (
  SELECT c_custkey, coalesce(d_name, p_name) AS c_name, coalesce(d_nationkey, p_nationkey) AS c_nationkey,
         coalesce(d_acctbal, p_acctbal) AS c_acctbal, coalesce(d_mktsegment, p_mktsegment) AS c_mktsegment,
         CASE WHEN action = 'create' THEN '{NOW}' ELSE '{THEN}' END AS created_at,
         CASE WHEN action = 'no-op' THEN '{THEN}' ELSE '{NOW}' END AS updated_at
  FROM changes WHERE action <> 'delete')
SELECT {APPLIED_COLUMNS} FROM after"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        KEY, "c_name", "c_nationkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment",
        F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"),
    )


def _customer_snapshot(t: Tables) -> DataFrame:
    return with_timestamps(customer_prior(t), _stamp(THEN))


@query(APPLIED, "apply_changes")
def _apply_changes(t: Tables) -> DataFrame:
    prior = _customer_snapshot(t)
    changes = materialize(actionable(plan(customer_desired(t), prior, KEY)), "changes")
    return _shown(apply_changes(prior, changes, KEY, _stamp(NOW)))


@query(APPLIED, "apply_in_one_join")
def _apply_in_one_join(t: Tables) -> DataFrame:
    """The same snapshot straight from the change set, without a second join."""
    prior = _customer_snapshot(t)
    changes = plan(customer_desired(t), prior, KEY)
    return _shown(snapshot_of(changes, KEY, prior.schema, _stamp(NOW)))


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT 'base' AS lineage, CAST((SELECT max(c_custkey) FROM prior) + count(*) AS BIGINT) AS serial
FROM changes WHERE action <> 'no-op'"""
)
def apply_serial(t: Tables) -> DataFrame:
    """One serial step per applied change."""
    version = customer_prior(t).agg(F.lit("base").alias("lineage"), F.max(KEY).alias("serial"))
    return next_serial(version, _customer_plan(t))


@query(
    f"""WITH {CUSTOMER_CHANGES},
counted AS (SELECT CAST(count(*) FILTER (WHERE action <> 'no-op') AS BIGINT) AS serial FROM changes),
after AS (
  SELECT c_custkey, coalesce(d_name, p_name) AS c_name, coalesce(d_nationkey, p_nationkey) AS c_nationkey,
         coalesce(d_acctbal, p_acctbal) AS c_acctbal, coalesce(d_mktsegment, p_mktsegment) AS c_mktsegment,
         CASE WHEN action = 'create' THEN '{NOW}' ELSE '{THEN}' END AS created_at,
         CASE WHEN action = 'no-op' THEN '{THEN}' ELSE '{NOW}' END AS updated_at
  FROM changes WHERE action <> 'delete')
SELECT {APPLIED_COLUMNS}, (SELECT serial FROM counted) AS serial FROM after"""
)
def saved_plan_roundtrip(t: Tables) -> DataFrame:
    """Plan, save, load, apply through the versioned store."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"), KEY)
    store.create(customer_prior(t), _stamp(THEN), lineage="base")
    path = scratch_path(t.spark, "saved-plan")
    save_plan(store.plan(customer_desired(t)), path)
    version = store.apply(load_plan(t.spark, path), _stamp(NOW))
    return _shown(store.read(version)).withColumn("serial", F.lit(version.serial).cast("long"))


@query(
    f"""WITH {CUSTOMER_PAIR}
SELECT c_custkey, 'no-op' AS action FROM desired"""
)
def store_replan(t: Tables) -> DataFrame:
    """After an apply the same desired table plans to nothing but no-ops."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"), KEY)
    store.create(customer_prior(t), _stamp(THEN))
    store.apply(store.plan(customer_desired(t)), _stamp(NOW))
    return store.plan(customer_desired(t)).changes.select(KEY, "action")


@query(
    f"""WITH {CUSTOMER_CHANGES}
SELECT 'plan_prior' AS "check", CAST(c_custkey AS VARCHAR) AS key, 'no prior row for ' || action AS message
FROM changes WHERE action IN ('update', 'delete') AND p_mktsegment = 'MACHINERY'"""
)
def bad_plan_rows(t: Tables) -> DataFrame:
    """A change set checked against a snapshot that lost a segment meanwhile."""
    lost = customer_prior(t).filter("c_mktsegment <> 'MACHINERY'")
    return check_plan(_customer_plan(t), lost, KEY)


@query(
    f"""WITH {ORDERS_PAIR}
SELECT s.o_orderkey, CASE WHEN l.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS action,
       CASE WHEN l.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
         CASE WHEN l.o_totalprice <> s.o_totalprice THEN 'o_totalprice' END,
         CASE WHEN l.o_orderpriority <> s.o_orderpriority THEN 'o_orderpriority' END) END AS changed
FROM state s LEFT JOIN live l USING (o_orderkey)
WHERE l.o_orderkey IS NULL OR l.o_totalprice <> s.o_totalprice OR l.o_orderpriority <> s.o_orderpriority"""
)
def drift_orders(t: Tables) -> DataFrame:
    return drift(orders_state(t), orders_live(t), "o_orderkey").select("o_orderkey", "action", _changed())


def _order_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"),
        "o_orderpriority", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
    )


REFRESHED = """SELECT s.o_orderkey, s.o_custkey, s.o_orderstatus, CAST(l.o_totalprice AS VARCHAR) AS o_totalprice,
       {priority} AS o_orderpriority, strftime(s.created_at, '%Y-%m-%d') AS created_on,
       CASE WHEN l.o_totalprice <> s.o_totalprice {also} THEN '2024-06-01'
            ELSE strftime(s.updated_at, '%Y-%m-%d') END AS updated_on
FROM state s JOIN live l USING (o_orderkey)"""


@query(
    f"WITH {ORDERS_PAIR} "
    + REFRESHED.format(priority="l.o_orderpriority", also="OR l.o_orderpriority <> s.o_orderpriority")
)
def refresh_state(t: Tables) -> DataFrame:
    return _order_rows(refresh(orders_state(t), orders_live(t), "o_orderkey", _stamp(NOW)))


@query(f"WITH {ORDERS_PAIR} " + REFRESHED.format(priority="s.o_orderpriority", also=""))
def refresh_echo(t: Tables) -> DataFrame:
    """An echoed column keeps the stored value and is never compared."""
    kept = refresh(orders_state(t), orders_live(t), "o_orderkey", _stamp(NOW), echo=["o_orderpriority"])
    return _order_rows(kept)


@query(
    """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || upper(event_type)
  || '","user":"' || user_id || '"}' AS attrs FROM events"""
)
def apply_merged_map(t: Tables) -> DataFrame:
    """Applying a partial map keeps the stored keys that were not declared."""
    asked = t.events.select(
        "event_id",
        F.create_map(
            F.lit("type"), F.upper("event_type"), F.lit("user"), F.col("user_id").cast("string")
        ).alias("attrs"),
    )
    prior = t.events.select("event_id", _event_map().alias("attrs"))
    after = apply_changes(prior, plan(asked, prior, "event_id"), "event_id", _stamp(NOW))
    entries = F.map_from_entries(F.array_sort(F.map_entries("attrs")))
    return after.select("event_id", F.to_json(entries).alias("attrs"))


@query(
    """SELECT event_id, upper(event_type) AS kind, CAST(user_id AS BIGINT) AS user, CAST(value AS VARCHAR) AS value FROM events"""
)
def apply_struct_by_name(t: Tables) -> DataFrame:
    """Struct fields meet by name: declared in another order and in part, the rest is kept."""
    desired = t.events.select("event_id", F.struct(F.upper("event_type").alias("kind"), F.col("user_id").alias("user")).alias("attrs"))
    prior = t.events.select(
        "event_id",
        F.struct(F.lit(0).cast("long").alias("user"), F.col("value").cast("string").alias("value"), F.lit("old").alias("kind")).alias("attrs"),
    )
    after = apply_changes(prior, materialize(plan(desired, prior, "event_id"), "changes"), "event_id", _stamp(NOW))
    return after.select("event_id", "attrs.kind", "attrs.user", F.col("attrs.value").cast("double").cast("string").alias("value"))


@query(
    """SELECT event_id, '{"n":{"keep":' || user_id || ',"type":"' || event_type || '"},"z":1}' AS attrs FROM events"""
)
def apply_merged_json(t: Tables) -> DataFrame:
    """A partial document laid over the stored one keeps what it does not name."""
    kind = F.col("event_type")
    desired = t.events.select("event_id", parse(F.concat(F.lit('{"n":{"type":"'), kind, F.lit('"}}'))).alias("attrs"))
    stored = F.concat(F.lit('{"z":1,"n":{"keep":'), F.col("user_id").cast("string"), F.lit(',"type":"old"}}'))
    prior = t.events.select("event_id", parse(stored).alias("attrs"))
    after = apply_changes(prior, materialize(plan(desired, prior, "event_id"), "changes"), "event_id", _stamp(NOW))
    return after.select("event_id", F.to_json("attrs").alias("attrs"))


def _nested(inner: Column, levels: int) -> Column:
    return F.concat(F.lit('{"k":' * levels), inner, F.lit("}" * levels))


@query(
    """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'update' ELSE 'no-op' END AS action
FROM events"""
)
def diff_partial_json_deep(t: Tables) -> DataFrame:
    """Ten levels of objects around a wide one, whose stored copy holds one key more."""
    props = F.get_json_object("props", "$.k").cast("int")
    names = [f"f{i:02d}" for i in range(40)]
    fields = [F.concat(F.lit(f'"{n}":'), (F.col("user_id") + i).cast("string")) for i, n in enumerate(names)]

    def wide(last: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *fields, F.concat(F.lit('"last":'), last.cast("string"))), F.lit("}"))

    stored = F.concat(F.lit('{"more":0,'), F.substring(wide(F.when(props % 2 == 0, -1).otherwise(props)), 2, 1 << 20))
    desired = t.events.select("event_id", parse(_nested(wide(props), 10)).alias("attrs"))
    prior = t.events.select("event_id", parse(_nested(stored, 10)).alias("attrs"))
    return plan(desired, prior, "event_id").select("event_id", "action")


@query(
    """WITH k AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS nation, c_custkey % 40 AS slot FROM customer)
SELECT 'keys' AS "check", coalesce(CAST(nation AS VARCHAR), 'null') || '|' || slot AS key,
  CASE WHEN nation IS NULL THEN 'null in the key, rows: ' ELSE 'rows: ' END || count(*) AS message
FROM k GROUP BY nation, slot HAVING count(*) > 1 OR nation IS NULL"""
)
def plan_null_keys(t: Tables) -> DataFrame:
    """Rows that no plan accepts: their key holds a null or names several rows."""
    nation = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey"))
    return check_keys(t.customer.select(nation.alias("nation"), (F.col("c_custkey") % 40).alias("slot")), ["nation", "slot"])


@query(
    """SELECT 'plan_prior' AS "check", c_name || '|' || '|' || c_mktsegment AS key, 'no prior row for delete' AS message FROM customer"""
)
def bad_plan_rows_composite(t: Tables) -> DataFrame:
    """Composite keys with the joiner inside: the same text, but not the same key."""
    changes = t.customer.select(
        F.col("c_name").alias("a"), F.concat(F.lit("|"), "c_mktsegment").alias("b"), F.lit("delete").alias("action")
    )
    prior = t.customer.select(F.concat("c_name", F.lit("|")).alias("a"), F.col("c_mktsegment").alias("b"))
    return check_plan(changes, prior, ["a", "b"])


@query(
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'late' END AS note,
  CASE WHEN o_orderstatus = 'O' THEN '2024-06-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_on FROM orders"""
)
def refresh_new_column(t: Tables) -> DataFrame:
    """A column that only the live table has is taken over, and makes its rows new."""
    state = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("updated_at"))
    live = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "O", "late").alias("note"))
    after = refresh(state, live, "o_orderkey", _stamp(NOW))
    return after.select("o_orderkey", "o_orderstatus", "note", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))
