"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import written
from tablerecon.operators.skew import salted_join


def _directed(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once, without loops."""
    return (
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )


def _least(edges: DataFrame, both_ways: bool) -> tuple[DataFrame, DataFrame]:
    arcs = edges
    if both_ways:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = arcs.groupBy("u").agg(F.min("v").alias("low"))
    return arcs, least.select(F.col("u").alias("of"), F.least("u", "low").alias("low")) if both_ways else least.select(F.col("u").alias("of"), "low")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs, least = _least(edges, both_ways=True)
    near = salted_join(arcs, least, [("u", "of")], "inner").filter("v > u")
    return _directed(near.select(F.col("v").alias("u"), F.col("low").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    arcs, least = _least(edges, both_ways=False)
    near = salted_join(arcs, least, [("u", "of")], "inner")
    return _directed(
        near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            near.select("u", F.col("low").alias("v"))
        )
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )))
    held = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return held.filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that an edge ``(u, v)`` touches; the root is the smallest.

    Large-star and small-star steps alternate until the edges are stars around the
    roots; each round's edges are written.  No task holds a component.
    """
    edges = written(_directed(edges), "edges")
    while not _are_stars(edges):
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
