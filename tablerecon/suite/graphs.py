"""Dependency graphs over conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.operators.graph import (
    apply_order,
    delete_order,
    dependency_levels,
    find_cycles,
    prune_edges,
    topological_order,
)
from tablerecon.session import materialize
from tablerecon.suite.registry import Tables, query


def _id(turn=None):
    turn = F.col("turn") if turn is None else turn
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def turns(t: Tables) -> DataFrame:
    priority = F.when(F.col("role") == "user", 0).otherwise(1)
    return t.conversations.select(_id().alias("node"), priority.alias("priority"), "role", "turn")


def turn_edges(t: Tables) -> DataFrame:
    """A turn needs the two turns before it, known or not."""
    deps = F.array(_id(F.col("turn") - 1), _id(F.col("turn") - 2))
    return t.conversations.select(_id().alias("node"), F.explode(deps).alias("dep"))


GRAPH = """nodes AS (SELECT conv_id || ':' || turn AS node, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS priority,
    role, turn FROM conversations),
raw AS (SELECT conv_id || ':' || turn AS node, unnest([conv_id || ':' || (turn - 1), conv_id || ':' || (turn - 2)]) AS dep
    FROM conversations),
edges AS (SELECT DISTINCT node, dep FROM raw WHERE dep IN (SELECT node FROM nodes))"""

LEVELS = (
    GRAPH
    + """,
walk AS (SELECT node, 0 AS level FROM nodes UNION
  SELECT e.node, w.level + 1 FROM walk w JOIN edges e ON e.dep = w.node),
levels AS (SELECT node, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY 1)"""
)


@query(f"WITH {GRAPH} SELECT node, dep FROM edges", "prune_edges")
def _prune_edges(t: Tables) -> DataFrame:
    edges = turn_edges(t)
    return prune_edges(turns(t), edges.unionByName(edges))


@query(f"WITH RECURSIVE {LEVELS} SELECT node, level FROM levels")
def levels_conversations(t: Tables) -> DataFrame:
    return dependency_levels(turns(t), turn_edges(t))


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with their place in the order: offsets of the sorted partitions, then places within."""
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p")
    starts = before.agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("start"))
    placed = rows.join(starts, part == F.col("p")).withColumn("position", F.col("start") + within)
    return placed.select(*df.columns, "position")


@query(
    """WITH starts AS (SELECT event_id, CASE WHEN event_id % 5000 = 0 OR lag(event_id) OVER (ORDER BY event_id)
    IS DISTINCT FROM event_id - 1 THEN event_id END AS start FROM events)
SELECT event_id AS node, CAST(event_id - max(start) OVER (ORDER BY event_id) AS INTEGER) AS level FROM starts"""
)
def levels_event_chains(t: Tables) -> DataFrame:
    """Chains of thousands: an event needs the one before it, but every 5,000th."""
    nodes = t.events.select(F.col("event_id").alias("node"))
    edges = nodes.filter(F.col("node") % 5000 != 0).select("node", (F.col("node") - 1).alias("dep"))
    return dependency_levels(nodes, edges)


@query(
    f"""WITH RECURSIVE {LEVELS} SELECT level, priority, node,
  row_number() OVER (ORDER BY level, priority, node) - 1 AS position FROM levels JOIN nodes USING (node)"""
)
def topo_order_conversations(t: Tables) -> DataFrame:
    return _numbered(topological_order(turns(t), turn_edges(t), priority="priority"))


@query(
    f"""WITH RECURSIVE {GRAPH},
back AS (SELECT node, dep FROM edges UNION SELECT n.node, e.node FROM nodes n JOIN edges e ON e.dep = n.node
  WHERE n.role = 'system'),
loop AS (SELECT node FROM back b WHERE EXISTS (SELECT 1 FROM back x WHERE x.node = b.dep AND x.dep = b.node)
  UNION SELECT b.node FROM loop l JOIN back b ON b.dep = l.node)
SELECT DISTINCT node FROM loop"""
)
def cycle_nodes(t: Tables) -> DataFrame:
    """System turns made to need what needs them: they and all behind them are stuck."""
    edges = prune_edges(turns(t), turn_edges(t))
    system = turns(t).filter("role = 'system'").select(F.col("node").alias("sys"))
    back = edges.join(system, F.col("dep") == F.col("sys")).select(F.col("dep").alias("node"), F.col("node").alias("dep"))
    return find_cycles(turns(t), edges.unionByName(back))


DELETES = (
    LEVELS.replace("nodes AS (", "every AS (", 1).replace(
        "raw AS (", "nodes AS (SELECT * FROM every WHERE role <> 'user'), raw AS (", 1
    ).replace("edges AS (SELECT DISTINCT node, dep FROM raw WHERE dep IN (SELECT node FROM nodes))",
              "edges AS (SELECT DISTINCT node, dep FROM raw WHERE dep IN (SELECT node FROM nodes) AND node IN (SELECT node FROM nodes))")
)


@query(
    f"""WITH RECURSIVE {DELETES} SELECT level, priority, node,
  row_number() OVER (ORDER BY level DESC, priority DESC, node DESC) - 1 AS position FROM levels JOIN nodes USING (node)""",
    "delete_order",
)
def _delete_order(t: Tables) -> DataFrame:
    """Turns not by users go; edges count only among them."""
    return _numbered(delete_order(turn_edges(t), turns(t).filter("role <> 'user'"), priority="priority"))


@query(
    f"""WITH RECURSIVE {GRAPH},
todo AS (SELECT node, priority, CASE role WHEN 'user' THEN 'create' WHEN 'assistant' THEN 'delete' END AS action
  FROM nodes WHERE role IN ('user', 'assistant')),
inner_edges AS (SELECT e.node, e.dep FROM edges e JOIN todo a ON a.node = e.node JOIN todo b ON b.node = e.dep
  WHERE a.action = b.action),
walk AS (SELECT node, 0 AS level FROM todo UNION
  SELECT e.node, w.level + 1 FROM walk w JOIN inner_edges e ON e.dep = w.node),
levels AS (SELECT node, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY 1),
ranked AS (SELECT CAST(CASE action WHEN 'delete' THEN 1 ELSE 0 END AS INTEGER) AS phase,
  CAST(CASE action WHEN 'delete' THEN -level ELSE level END AS INTEGER) AS rank,
  CAST(CASE action WHEN 'delete' THEN -priority ELSE priority END AS INTEGER) AS priority, node, action
FROM todo JOIN levels USING (node))
SELECT *, row_number() OVER (ORDER BY phase, rank, priority, CASE phase WHEN 0 THEN node END,
  CASE phase WHEN 1 THEN node END DESC) - 1 AS position FROM ranked""",
    "apply_order",
)
def _apply_order(t: Tables) -> DataFrame:
    """User turns are created, assistant turns deleted, system turns left alone."""
    action = (
        F.when(F.col("role") == "user", "create").when(F.col("role") == "assistant", "delete").otherwise("no-op")
    )
    changes = turns(t).withColumn("action", action)
    return _numbered(apply_order(changes, turn_edges(t), turn_edges(t), priority="priority"))
