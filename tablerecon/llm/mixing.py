"""Mixing sources to target weights by a splitting tree of exact block quotas.

1. Targets: the sources share the total size by weight; none takes more than
   ``max_repeats`` times its own size, and what is left over is shared again.
2. Draw: a source is taken whole as often as its target allows, and once more in
   part: the documents first in a permuted order, cut where the target is met.  The
   cut is found digit by digit of the permuted key, from sums per digit, so no task
   sorts a source.
3. Blocks: the drawn order of each source is cut into blocks of about equal size.
   A tree splits the block quotas of all sources among the output shards: at every
   node the left half's share is a multivariate hypergeometric draw, so every shard
   gets whole blocks, every block one shard, and the mix of each shard is that of a
   random shuffle.  A shard's blocks of a source are a run of its permuted blocks.
4. Within a shard, documents are ordered by a hash.

Draws depend on the seed and the rows alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.llm.common import named, prepare, unused, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS = 64
BLOCKS_PER_SHARD = 16
SEED = 20_240_601

KEY_BITS, DIGIT_BITS = 56, 8
CELL_ROWS = 64  # a cell of so few documents is filled one by one


@dataclass
class Share:
    """One source's part of the mix."""

    source: str | None
    size: int
    target: float
    whole: int = 0  # times that it is taken whole
    cut: int = 0  # documents with keys below are taken once more
    picks: tuple[int, ...] = ()  # and those with these keys
    end: int = 0  # where the cell that the cut begins ends
    bounds: tuple[int, ...] = ()  # shard k holds the blocks from bounds[k] to bounds[k + 1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """A permuted place of a row, by its content: ``KEY_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, source, text), 64 - KEY_BITS)


def targets(sizes: dict[str | None, int], weights: Sequence[float], max_repeats: int) -> dict[str | None, float]:
    """Sources by code point, null last, weigh ``weights`` in turn and share the total size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    cap = {s: float(max_repeats * n) for s, n in sizes.items()}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > cap[s]]
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        free = [s for s in free if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source per shard, ``(shards, sources)``, by the splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts
            continue
        mid = (lo + hi) // 2
        total = int(counts.sum())
        draw = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left, rest, wanted = np.zeros_like(counts), total, draw
        for i, n in enumerate(counts.tolist()):
            rest -= n
            k = int(rng.hypergeometric(n, rest, wanted)) if wanted and n else 0
            left[i] = k
            wanted -= k
        todo.append((lo, mid, left))
        todo.append((mid, hi, counts - left))
    return out


def _find_cuts(rows: DataFrame, shares: list[Share]) -> None:
    """Set ``cut`` and ``picks`` so that the partial draw comes near what is left of the target.

    ``rows`` is ``(source, key, size)``.  Each level reads one sum per source and digit
    of the cell where the source's target falls; the driver holds those sums, never rows
    of more than ``CELL_ROWS`` different keys per source.
    """
    spark = rows.sparkSession
    rest = {i: s.target - s.whole * s.size for i, s in enumerate(shares)}
    cells = {i: 0 for i in rest if rest[i] >= 0.5}  # number of the cell at the level reached
    shift = KEY_BITS
    few: set[int] = set()
    while cells.keys() - few and shift > 0:
        shift -= DIGIT_BITS
        asked = [(shares[i].source, c, i) for i, c in cells.items() if i not in few]
        at = spark.createDataFrame(asked, "s string, cell bigint, i int")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift + DIGIT_BITS) == F.col("cell"))
        sums = rows.join(F.broadcast(at), inside).groupBy("i", F.shiftright("key", shift).alias("sub"))
        got = sums.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list] = {}
        for r in got:
            by.setdefault(r["i"], []).append((r["sub"], r["w"], r["n"]))
        for _, _, i in asked:
            cells[i] <<= DIGIT_BITS
            subs = sorted(by.get(i, []))
            for k, (sub, words, n) in enumerate(subs):
                cells[i] = sub
                if words > rest[i]:
                    # a small cell, and the next ones as long as they are few, are filled one by one
                    while n <= CELL_ROWS and k + 1 < len(subs) and n + subs[k + 1][2] <= CELL_ROWS:
                        k += 1
                        n += subs[k][2]
                    if n <= CELL_ROWS:
                        few.add(i)
                        shares[i].end = (subs[k][0] + 1) << shift
                    else:
                        shares[i].end = (sub + 1) << shift
                    break
                rest[i] -= words
                cells[i] = sub + 1
            else:
                few.add(i)  # everything fits
                shares[i].end = cells[i] << shift
            shares[i].cut = cells[i] << shift
    asked = [(shares[i].source, shares[i].cut, shares[i].end, i) for i in cells]
    if not asked:
        return
    at = spark.createDataFrame(asked, "s string, lo bigint, hi bigint, i int")
    inside = F.col("source").eqNullSafe(F.col("s")) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    near = rows.join(F.broadcast(at), inside).groupBy("i", "key").agg(F.sum("size").alias("w")).collect()
    by = {}
    for r in near:
        by.setdefault(r["i"], []).append((r["key"], r["w"]))
    for i, found in by.items():
        picks, spare = [], []
        for key, words in sorted(found):
            if words <= rest[i]:
                picks.append(key)
                rest[i] -= words
            else:
                spare.append((words - rest[i], key))
        if spare and min(spare)[0] < rest[i]:
            picks.append(min(spare)[1])
        shares[i].picks = tuple(picks)


def plan_mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> list[Share]:
    """The mix of ``rows`` ``(source, key, size)``: one share per source.

    The driver holds one row per source, with one bound per shard.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("w")).collect()
    sizes = {r["source"]: int(r["w"]) for r in sums}
    goal = targets(sizes, weights, max_repeats)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = [Share(s, sizes[s], goal[s]) for s in order]
    for s in shares:
        s.whole = min(max_repeats, int(s.target // s.size)) if s.size else 0
        if s.whole == max_repeats or not s.size:
            s.target = min(s.target, float(max_repeats * s.size))
    _find_cuts(rows, [s for s in shares if s.size and s.whole < max_repeats])
    total = sum(s.target for s in shares)
    blocks = shards * BLOCKS_PER_SHARD
    quotas = np.array([max(1, round(blocks * s.target / total)) if total else 1 for s in shares], np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if len(shares) else None
    for j, s in enumerate(shares):
        s.bounds = (0, *(int(x) for x in ends[:, j]))
    return shares


_PLAN = T.StructType(
    [
        T.StructField("p_source", T.StringType()),
        T.StructField("p_size", T.LongType()),
        T.StructField("p_target", T.DoubleType()),
        T.StructField("p_whole", T.IntegerType()),
        T.StructField("p_cut", T.LongType()),
        T.StructField("p_picks", T.ArrayType(T.LongType())),
        T.StructField("p_bounds", T.ArrayType(T.LongType())),
    ]
)


def _planned(rows: DataFrame, shares: list[Share], source: str, key: str, seed: int) -> DataFrame:
    """``rows`` with ``p_size``, ``p_target``, ``repeats`` and ``shards``, one shard per copy."""
    spark = rows.sparkSession
    data = [(s.source, s.size, s.target, s.whole, s.cut, list(s.picks), list(s.bounds)) for s in shares]
    plan = spark.createDataFrame(data, _PLAN)
    out = rows.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col("p_source")), "left")
    again = (F.col(key) < F.col("p_cut")) | F.array_contains("p_picks", F.col(key))
    repeats = F.col("p_whole") + F.when(again, 1).otherwise(0)
    unit = float(1 << KEY_BITS)
    quota = F.element_at("p_bounds", -1)

    def shard(epoch: Column) -> Column:
        # every full round has a permutation of its own, the partial one that of its cut
        turned = F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col(key)), 64 - KEY_BITS)
        place = F.when(epoch < F.col("p_whole"), turned).otherwise(F.col(key)) / unit
        block = F.floor((epoch + place) * F.col("p_size") / F.col("p_target") * quota)
        block = F.least(F.greatest(block, F.lit(0)), quota - 1)
        return F.size(F.filter("p_bounds", lambda b: b <= block)) - 1

    epochs = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.col("repeats") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("repeats", repeats)
    return out.withColumn("shards", F.transform(epochs, shard)).drop("p_source", "p_whole", "p_cut", "p_picks", "p_bounds")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, repeats, shards)``, one row per input row.

    ``size`` counts words; a null or empty text has none and adds nothing to the mix.
    A null source is a source of its own.  Rows that repeat id, source and text share a
    place and are taken or left together.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        _key(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("key"),
    )
    rows = written(rows, "mix-sizes")
    shares = plan_mix(rows.select("source", "key", "size"), weights, max_repeats, shards, seed)
    out = _planned(rows, shares, "source", "key", seed)
    return out.select(
        "doc_id", "source", "size", F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), "repeats", "shards"
    )


def draw_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = SEED,
    shard_col: str | None = None,
) -> DataFrame:
    """The mixed documents: every drawn copy as a row of ``docs``, shard by shard, shuffled within.

    ``shard_col`` adds the shard under that name.  Nulls, empty texts and repeated rows count as in
    ``mix``; a text without words is in no mix.  An empty table stays empty; other columns may
    have any names.
    """
    prepare(docs.sparkSession)
    key, source = unused(docs, "__key"), unused(docs, "__source")
    keyed = docs.withColumn(key, _key(F.col(id_col), F.col(source_col), F.col(text_col), seed))
    keyed = keyed.withColumn(source, F.col(source_col).cast("string"))
    sizes = written(
        keyed.select(F.col(source).alias("source"), F.col(key).alias("key"), word_count(F.col(text_col)).alias("size")), "mix-sizes"
    )
    shares = plan_mix(sizes, weights, max_repeats, shards, seed)
    # the packed columns keep their names apart from those of the plan
    packed = keyed.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"), F.col(key).alias("key"), F.col(source).alias("source"))
    copies = _planned(packed, shares, "source", "key", seed).select("doc", "key", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed), "key", "copy")
    laid = copies.withColumn("order", order).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "order")
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    return laid.select(*columns, *([F.col("shard").alias(shard_col)] if shard_col else []))
