"""Merkle manifest of a table by slot pivots.

Rows become leaves, leaves of a group are numbered in order, and every run of ``fanout``
neighbours becomes one parent, until one node of the group is left.  The groups' roots
are the leaves of one more tree.

1. Numbering: rows are range partitioned by (group, id) and sorted; a row's number is
   its place in its partition plus what earlier partitions hold of its group.  No task
   holds a group.
2. Up: a level groups by parent, and conditional aggregates put each child into the
   column of its slot.  The columns side by side are hashed to the parent.
3. Down: a level's rows, joined with their own proof, hand each slot the other columns
   (left and right of it) in front of that proof.  The lowest level hands out the rows,
   which travelled up one level inside their slot, so that a proof is never joined with
   single rows.

Levels shrink by the fanout, so all levels together shuffle about half as many rows as
there are leaves; a proof has two digests a level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerecon.llm.common import prepare, written

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WRITE_EVERY = 4  # levels on the way down between two written tables

PROOF = "array<struct<left:binary,right:binary>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the encoded values in a row."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_digest(children: Column) -> Column:
    """SHA-256 (binary) of the children's digests, side by side as lowercase hex."""
    return F.unhex(F.sha2(_hex(children), 256))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, step: node_digest(F.concat(step["left"], d, step["right"])))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all digests of a proof in a row, as lowercase hex."""
    side_by_side = F.aggregate(
        proof, F.lit(b"").cast("binary"), lambda seen, step: F.concat(seen, step["left"], step["right"])
    )
    return F.sha2(_hex(side_by_side), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their number within ``grp``, and ``width``, the group's size.

    Nulls come first, strings are ordered by their UTF-8 bytes.
    """
    by = ["grp", *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number holds the partition in its high bits; written, it never changes again
    at = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    at = at.withColumn("part", F.shiftright("at", 33))
    runs = at.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("grp").alias("g"),
        F.col("part").alias("p"),
        (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(whole).alias("width"),
    )
    out = at.join(runs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "g", "p", "shift")


def _pivot(nodes: DataFrame, fanout: int, value: Column) -> DataFrame:
    """One row per parent; ``value`` of the child in slot ``i`` stands in column ``c{i}``."""
    slot = F.col("pos") % fanout
    children = [F.max(F.when(slot == i, value)).alias(f"c{i}") for i in range(fanout)]
    parent = F.floor(F.col("pos") / fanout) if fanout == 1 else F.expr(f"pos div {fanout}")
    return nodes.groupBy("grp", parent.alias("pos"), "width").agg(*children)


def _side_by_side(columns: Sequence[Column]) -> Column:
    """Binary columns joined, nulls left out."""
    empty = F.lit(b"").cast("binary")
    return F.concat(empty, *[F.coalesce(c, empty) for c in columns])


@dataclass
class Forest:
    """Levels of all groups' trees, lowest first: ``(grp, pos, width, c0.., digest)``.

    ``roots`` has ``(grp, digest, height)``.
    """

    fanout: int
    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, fanout: int, widest: int, payload: bool) -> Forest:
    """The trees above ``leaves`` (grp, pos, width, digest[, payload])."""
    if fanout < 2:
        raise ValueError("a parent needs two children or more")
    levels: list[DataFrame] = []
    nodes = leaves
    roots = nodes.filter("width = 1").select("grp", "digest", F.lit(0).alias("height"))
    while widest > 1:
        with_rows = payload and not levels
        value = F.struct("digest", "payload") if with_rows else F.col("digest")
        level = _pivot(nodes.filter("width > 1"), fanout, value)
        slots = [F.col(f"c{i}.digest" if with_rows else f"c{i}") for i in range(fanout)]
        level = level.withColumn("digest", node_digest(_side_by_side(slots)))
        level = written(level.withColumn("width", F.expr(f"(width + {fanout - 1}) div {fanout}")), "merkle-level")
        levels.append(level)
        nodes = level.select("grp", "pos", "width", "digest")
        top = nodes.filter("width = 1").select("grp", "digest", F.lit(len(levels)).alias("height"))
        roots = roots.unionByName(top)
        widest = -(-widest // fanout)
    return Forest(fanout, levels, roots)


def descend(forest: Forest, leaves: DataFrame, tops: DataFrame, payload: bool) -> DataFrame:
    """``(grp, pos, digest[, payload], proof, carried...)`` of every leaf.

    ``tops`` has ``(grp, height, proof, ...)`` of every root; further columns are carried down.
    """
    carried = [c for c in tops.columns if c not in ("grp", "height", "proof")]
    names = ["grp", "pos", "digest", *(["payload"] if payload else []), "proof", *carried]
    zero = F.lit(0).cast("long").alias("pos")
    here: DataFrame | None = None
    for height in range(len(forest.levels), 0, -1):
        level, with_rows = forest.levels[height - 1], payload and height == 1
        top = tops.filter(F.col("height") == height).select("grp", zero, "proof", *carried)
        here = top if here is None else here.unionByName(top)
        up = here.select(F.col("grp").alias("g"), F.col("pos").alias("p"), "proof", *carried)
        rows = level.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p")))
        digest = lambda i: F.col(f"c{i}.digest" if with_rows else f"c{i}")  # noqa: E731, B023
        slots = []
        for i in range(forest.fanout):
            step = F.struct(
                _side_by_side([digest(j) for j in range(i)]).alias("left"),
                _side_by_side([digest(j) for j in range(i + 1, forest.fanout)]).alias("right"),
            )
            fields = [F.lit(i).cast("long").alias("slot"), digest(i).alias("digest"), step.alias("step")]
            slots.append(F.struct(*fields, *([F.col(f"c{i}.payload").alias("payload")] if with_rows else [])))
        rows = rows.select("grp", "pos", "proof", *carried, F.explode(F.array(*slots)).alias("s"))
        rows = rows.filter("s.digest IS NOT NULL").select(
            "grp",
            (F.col("pos") * forest.fanout + F.col("s.slot")).alias("pos"),
            F.col("s.digest").alias("digest"),
            *([F.col("s.payload").alias("payload")] if with_rows else []),
            F.concat(F.array("s.step"), F.col("proof")).cast(PROOF).alias("proof"),
            *carried,
        )
        if height == 1:
            here = rows
        else:
            here = rows.drop("digest")
            if (len(forest.levels) - height) % WRITE_EVERY == WRITE_EVERY - 1:
                here = written(here, "merkle-proofs")
    alone = tops.filter("height = 0").withColumnRenamed("grp", "g").drop("height")
    single = leaves.filter("width = 1").join(alone, F.col("grp").eqNullSafe(F.col("g"))).select(*names)
    return single if here is None else here.select(*names).unionByName(single)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    columns: Sequence[str] = COLUMNS,
    seen: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Leaf, roots and proof of every row, and whether the row as it is now still folds to the root.

    One row per row of ``docs``: ``id``, ``grp``, ``leaf``, ``subroot``, ``root``, ``folded_root``
    (lowercase hex), ``proof`` (per level the digests left and right of the path, binary) and
    ``verified``.  A leaf hashes ``columns``; ``seen`` replaces some of them by what is found
    now, by default the same.  Within a group rows ascend by id, null first, rows of one id by
    their leaf; equal rows are leaves of their own.  Null groups are one group and come first.
    Nulls in hashed columns differ from empty texts.  An empty table gives an empty result;
    columns that are not named are ignored, whatever they are called.
    """
    prepare(docs.sparkSession)
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    now = [(seen or {}).get(c, named(c)) for c in columns]
    rows = docs.select(
        named(group_col).alias("grp"),
        named(id_col).alias("id"),
        leaf_digest([named(c) for c in columns]).alias("digest"),
        leaf_digest(now).alias("now") if seen else F.lit(None).cast("binary").alias("now"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = written(rows, "merkle-leaves")
    # equal rows may be many: the tie lets their range be cut as well
    leaves = _numbered(rows, ["id", "digest", "tie"]).withColumn("payload", F.struct("id", "now"))
    leaves = written(leaves.select("grp", "pos", "width", "digest", "payload"), "merkle-numbered")
    forest = grow(leaves, fanout, leaves.agg(F.max("width")).first()[0] or 0, payload=True)

    subroots = forest.roots.select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "digest", "height")
    subroots = _numbered(subroots, ["source"]).withColumn("payload", F.struct("source", "height"))
    subroots = written(subroots.select("grp", "pos", "width", "digest", "payload"), "merkle-subroots")
    above = grow(subroots, fanout, subroots.agg(F.max("width")).first()[0] or 0, payload=True)
    root = above.roots.select(
        "grp", "height", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root")
    )
    tops = descend(above, subroots, root, payload=True).select(
        F.col("payload.source").alias("grp"),
        F.col("payload.height").alias("height"),
        "proof",
        F.col("digest").alias("subroot"),
        "root",
    )
    found = descend(forest, leaves, written(tops, "merkle-tops"), payload=True)
    back = folded(F.coalesce("payload.now", "digest"), F.col("proof"))
    found = found.withColumn("back", back)
    return found.select(
        F.col("payload.id").alias("id"),
        "grp",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        "proof",
        _hex(F.col("back")).alias("folded_root"),
        (F.col("back") == F.col("root")).alias("verified"),
    )
