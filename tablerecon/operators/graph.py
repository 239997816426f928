"""Dependency levels over edge tables.

An edge ``(node, dep)`` says that ``node`` needs ``dep``.

1. Chains are contracted: a node with one dependency and one dependent only passes a level
   on.  Pointers double their reach each round until they stand on the end of their chain,
   so a chain of n steps takes about log2(n) rounds; its nodes then follow from that end.
2. Peeling places a node of what is left once all it needs has been placed, one above the
   highest, and writes it to the shared folder in that round.  So lineage stays one round
   deep, a lost executor replays one round only, and the written rounds are the level table.

Rounds: the logarithm of the longest chain, and the longest path that no chain shortens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import DependencyCycleError
from tablerecon.operators.skew import salted_join
from tablerecon.session import materialize, scratch_path

_SHOWN = 20


def prune_edges(nodes: DataFrame, edges: DataFrame, node: str = "node", dep: str = "dep") -> DataFrame:
    """Edges between known nodes, each once.

    Duplicates go first: the two semi joins then see distinct edges only.
    """
    known = nodes.select(F.col(node).alias("__n"))
    distinct = edges.select(F.col(node).alias("node"), F.col(dep).alias("dep")).distinct()
    kept = salted_join(distinct, known, [("dep", "__n")], "left_semi")
    return salted_join(kept, known, [("node", "__n")], "left_semi")


@dataclass
class Peel:
    """What peeling leaves: nodes above level 0 with their level (``round``), and nodes without one."""

    nodes: DataFrame
    placed: DataFrame | None
    stuck: DataFrame | None


def _written(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``df`` written and read back, and how many rows it has."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(node, dep, weight)`` without chains, and ``(node, end, distance)`` of the nodes taken out.

    ``edges`` must be distinct.  Chains that run in a circle stay.
    """
    spark = edges.sparkSession
    plain = edges.withColumn("weight", F.lit(1).cast("long"))
    ends = edges.select(
        F.explode(F.array(
            F.struct(F.col("node").alias("at"), F.lit(1).alias("down"), F.lit(0).alias("up")),
            F.struct(F.col("dep").alias("at"), F.lit(0).alias("down"), F.lit(1).alias("up")),
        )).alias("e")
    )
    inner = ends.groupBy("e.at").agg(F.sum("e.down").alias("down"), F.sum("e.up").alias("up"))
    inner = materialize(inner.filter("down = 1 AND up = 1").select("at"), "chain-nodes")
    inside = inner.select(F.col("at").alias("__a"))
    steps = edges.join(inside, F.col("node") == F.col("__a"), "left_semi")
    links = steps.join(inside.withColumn("__in", F.lit(True)), F.col("dep") == F.col("__a"), "left")
    links = links.select(
        "node", F.col("dep").alias("end"), F.lit(1).cast("long").alias("distance"), F.col("__in").isNotNull().alias("open")
    )
    root = scratch_path(spark, "chains")
    first = Observation()
    links, n = _written(links.observe(first, F.count(F.when(F.col("open"), 1)).alias("open")), f"{root}/0")
    open_now = first.get["open"]
    if not open_now:
        return plain, None
    round_no = 0
    # in a circle pointers never come to an end; all others have after this many rounds
    while open_now and round_no <= n.bit_length():
        round_no += 1
        ahead = links.select(
            F.col("node").alias("__n"), F.col("end").alias("__e"), F.col("distance").alias("__d"), F.col("open").alias("__o")
        )
        # only one pointer stands on a node inside a chain, so no key is hot here
        far = links.filter("open").join(ahead, F.col("end") == F.col("__n")).select(
            "node", F.col("__e").alias("end"), (F.col("distance") + F.col("__d")).alias("distance"), F.col("__o").alias("open")
        )
        still = Observation()
        far = far.observe(still, F.count(F.when(F.col("open"), 1)).alias("open"))
        links, _ = _written(links.filter("NOT open").unionByName(far), f"{root}/{round_no}")
        open_now = still.get["open"]
    chains = links.filter("NOT open").select("node", "end", "distance")
    taken = chains.select(F.col("node").alias("__n"), F.col("end").alias("__e"), F.col("distance").alias("__d"))
    left = plain.join(taken.select("__n"), F.col("node") == F.col("__n"), "left_anti")
    left = left.join(taken, F.col("dep") == F.col("__n"), "left").select(
        "node", F.coalesce("__e", "dep").alias("dep"), (F.col("weight") + F.coalesce("__d", F.lit(0))).alias("weight")
    )
    # two chains may join the same two nodes: the longer one counts
    return materialize(left.groupBy("node", "dep").agg(F.max("weight").alias("weight")), "edges"), chains


def peel(nodes: DataFrame, edges: DataFrame, node: str = "node", dep: str = "dep") -> Peel:
    """Place nodes round by round, each once, in the round after the last of its deps.

    A round joins the edges last written with the nodes placed since and writes the nodes
    whose deps are all placed.  The edges are counted when half of the nodes are placed, and
    written again only when half of them are gone, so all writing is within nodes + 3 x edges;
    chains of n nodes take n x log2(n) more.
    """
    spark = nodes.sparkSession
    root = scratch_path(spark, "peel")
    all_nodes = nodes.select(F.col(node).alias("node")).distinct()
    every = materialize(
        prune_edges(all_nodes, edges.select(F.col(node).alias("node"), F.col(dep).alias("dep"))), "edges"
    )
    base, chains = contract(every)
    kind = all_nodes.schema["node"].dataType
    one = T.StructType([T.StructField("node", kind), T.StructField("round", T.LongType())])
    # Nodes without edges of their own have level 0 from the start.
    waiting, waits = _written(base.select(F.col("node").alias("__w")).distinct(), f"{root}/waiting")
    grounds = salted_join(base, waiting, [("dep", "__w")], "left_anti").select(F.col("dep").alias("node")).distinct()
    since, round_no = [f"{root}/step-0"], 0
    grounds.withColumn("round", F.lit(0).cast("long")).write.parquet(since[0])
    looked, held = waits, None
    while waits:
        round_no += 1
        gone = spark.read.schema(one).parquet(*since).select(F.col("node").alias("__g"), "round")
        # Many edges may need one hub, so no task may get them all.
        met = salted_join(base, gone, [("dep", "__g")], "left")
        above = F.when(F.col("dep").isNull(), F.col("weight")).otherwise(F.col("round") + F.col("weight"))
        met = met.select("node", "dep", "weight", above.alias("above"))
        ready = met.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.count("above").alias("known"), F.max("above").alias("round")
        )
        ready = ready.filter("n = known").select("node", "round")
        ready = ready.join(gone.select(F.col("__g").alias("__s")), F.col("node") == F.col("__s"), "left_anti")
        path = f"{root}/step-{round_no}"
        _, fresh = _written(ready, path)
        if not fresh:
            # Nobody is left to place, but for a cycle and the nodes behind one.
            break
        since.append(path)
        waits -= fresh
        if waits and 2 * waits <= looked:
            done = spark.read.schema(one).parquet(*since).select(F.col("node").alias("__s"))
            open_edges = met.join(done, F.col("node") == F.col("__s"), "left_anti")
            looked, held = waits, base.count() if held is None else held
            left = open_edges.filter("above IS NULL").count()
            if 2 * left <= held:
                # of edges whose dep is placed, the highest says all
                floor = open_edges.filter("above IS NOT NULL").groupBy("node").agg(F.max("above").alias("weight"))
                floor = floor.select("node", F.lit(None).cast(kind).alias("dep"), "weight")
                base = materialize(open_edges.filter("above IS NULL").select("node", "dep", "weight").unionByName(floor), "edges")
                held, since = left, [path]
    if not round_no:
        placed = None
    else:
        placed = spark.read.schema(one).parquet(*[f"{root}/step-{i}" for i in range(round_no + 1)])
        placed = placed.select("node", "round").filter("round > 0")
    stuck = None
    if waits:
        done = spark.read.schema(one).parquet(*[f"{root}/step-{i}" for i in range(round_no + 1)])
        done = done.select(F.col("node").alias("__s"))
        stuck = base.select("node").distinct().join(done, F.col("node") == F.col("__s"), "left_anti")
        if stuck.isEmpty():
            stuck = None
    if chains is not None:
        lost = None if stuck is None else stuck.select(F.col("node").alias("__x"))
        behind = None if lost is None else salted_join(chains, lost, [("end", "__x")], "left_semi").select("node")
        kept = chains if lost is None else salted_join(chains, lost, [("end", "__x")], "left_anti")
        if placed is None:
            own = kept.select("node", F.col("distance").alias("round"))
        else:
            at = placed.select(F.col("node").alias("__p"), F.col("round").alias("__r"))
            own = salted_join(kept, at, [("end", "__p")], "left").select(
                "node", (F.coalesce("__r", F.lit(0)) + F.col("distance")).alias("round")
            )
        placed = own if placed is None else placed.unionByName(own)
        stuck = stuck if behind is None else stuck.unionByName(behind)
    return Peel(all_nodes, placed, stuck)


def find_cycles(nodes: DataFrame, edges: DataFrame, node: str = "node", dep: str = "dep") -> DataFrame:
    """Nodes that never become ready: members of a cycle and nodes behind one."""
    done = peel(nodes, edges, node, dep)
    if done.stuck is None:
        return done.nodes.filter(F.lit(False))
    return done.stuck.select("node").distinct()


def dependency_levels(
    nodes: DataFrame, edges: DataFrame, node: str = "node", dep: str = "dep"
) -> DataFrame:
    """``(node, level)``: 0 without dependencies, else one above the highest."""
    done = peel(nodes, edges, node, dep)
    if done.stuck is not None:
        stuck = done.stuck.select("node").distinct()
        bad = stuck.orderBy("node").limit(_SHOWN + 1).collect()
        raise DependencyCycleError([str(r[0]) for r in bad[:_SHOWN]], more=len(bad) > _SHOWN, frame=stuck)
    if done.placed is None:
        return done.nodes.select("node", F.lit(0).alias("level"))
    return done.nodes.join(done.placed, "node", "left").select(
        "node", F.coalesce("round", F.lit(0)).cast("int").alias("level")
    )


def topological_order(
    nodes: DataFrame,
    edges: DataFrame,
    node: str = "node",
    dep: str = "dep",
    priority: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """``(level, priority, node)`` sorted so that dependencies come first.

    The sort is a distributed range sort.  ``descending`` gives the reverse
    order, for deletes.
    """
    levels = dependency_levels(nodes, edges, node, dep)
    if priority is not None:
        ranks = nodes.select(F.col(node).alias("node"), F.col(priority).alias("priority"))
        levels = levels.join(ranks, "node")
    else:
        levels = levels.withColumn("priority", F.lit(0))
    cols: Sequence[str] = ("level", "priority", "node")
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in cols]
    return levels.select(*cols).orderBy(*keys)


def delete_order(
    prior_edges: DataFrame,
    delete_keys: DataFrame,
    node: str = "node",
    dep: str = "dep",
    priority: str | None = None,
) -> DataFrame:
    """Dependents before what they need, among the nodes to delete."""
    return topological_order(delete_keys, prior_edges, node, dep, priority, descending=True)


def apply_order(
    changes: DataFrame,
    desired_edges: DataFrame,
    prior_edges: DataFrame,
    key: str = "node",
    priority: str | None = None,
    node: str = "node",
    dep: str = "dep",
) -> DataFrame:
    """``(phase, rank, priority, node, action)``: creates and updates, then deletes.

    ``rank`` grows in execution order inside a phase; no-ops are left out.
    """
    cols = [F.col(key).alias("node"), F.col("action")]
    if priority is not None:
        cols.append(F.col(priority).alias("priority"))
    todo = changes.filter(F.col("action") != "no-op").select(*cols)
    build = todo.filter(F.col("action") != "delete")
    drop = todo.filter(F.col("action") == "delete")
    given = "priority" if priority is not None else None
    up = topological_order(
        build, desired_edges.select(F.col(node).alias("node"), F.col(dep).alias("dep")), priority=given
    ).select(F.lit(0).alias("phase"), F.col("level").alias("rank"), "priority", "node")
    down = topological_order(
        drop, prior_edges.select(F.col(node).alias("node"), F.col(dep).alias("dep")), priority=given
    ).select(F.lit(1).alias("phase"), (-F.col("level")).alias("rank"), (-F.col("priority")).alias("priority"), "node")
    ranked = up.unionByName(down).join(todo.select("node", "action"), "node")
    # Equal ranks of the delete phase go as in ``delete_order``: by node, descending.
    building, dropping = (F.when(F.col("phase") == p, F.col("node")) for p in (0, 1))
    return ranked.select("phase", "rank", "priority", "node", "action").orderBy(
        "phase", "rank", "priority", building.asc(), dropping.desc()
    )
