"""Exact deduplication by skew-safe combining, in DataFrame expressions only.

1. Local: every task combines its own rows of equal (digest, salt, text) before
   anything is shuffled (Spark's partial aggregation).
2. Salted: the combined rows of one digest are spread over salts, taken from the
   row's id, and merged per (digest, salt, text).
3. Global: the salt winners of one (digest, text) meet, at most one per salt.

The text itself is a grouping key at each stage, so equal digests of different
texts are never merged.  The winners without their texts are written once; a row
finds its class by digest.  Digests that several texts share, if there are any,
are looked up by digest and text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import fold_ascii, prepare, shuffle_partitions, unused, written


def _normalised(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] | None) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("norm"))
    base = base.withColumn("text_sha256", F.sha2("norm", 256))
    return base.withColumn("digest", digest(F.col("norm")) if digest else F.unhex("text_sha256"))


def _winners(base: DataFrame, salts: int) -> DataFrame:
    salted = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return merged.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int | None = None,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty.  The largest id of a class stays.  A null id stays only where the whole
    class has null ids.  Rows that repeat both id and text are counted one by one
    and all marked as kept.  An empty table gives an empty result; other columns
    are ignored.  ``salts`` defaults to the number of shuffle partitions, and
    ``digest`` replaces SHA-256 as the key that rows are spread by.
    """
    spark = prepare(docs.sparkSession)
    base = _normalised(docs, id_col, text_col, digest)
    winners = _winners(base, salts or max(8, shuffle_partitions(spark)))
    classes = written(winners.select("digest", "keep_id", "group_size"), "dedup-classes")
    rows = base.select("doc_id", "text_sha256", "digest")
    shared = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    if shared.isEmpty():
        found = rows.join(classes, "digest")
    else:
        shared = written(shared, "dedup-shared")
        alone = rows.join(shared, "digest", "left_anti").join(classes, "digest")
        texts = base.join(shared, "digest", "left_semi")
        again = _winners(texts, salts or max(8, shuffle_partitions(spark)))
        found = alone.unionByName(texts.join(again, ["digest", "norm"]).drop("norm"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, columns unchanged.

    Of a class the row with the largest id stays; of rows that repeat id and text one.  A null
    text counts as empty, a null id as smaller than all others.  An empty table stays empty;
    other columns may have any names.
    """
    sha, k_id, k_sha = (unused(docs, n) for n in ("__sha", "k_id", "k_sha"))
    kept = written(
        exact_duplicates(docs, id_col, text_col)
        .filter("kept")
        .select(F.col("doc_id").alias(k_id), F.col("text_sha256").alias(k_sha)),
        "dedup-kept",
    )
    repeated = not kept.groupBy(k_id, k_sha).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    match = F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha))
    rows = docs.withColumn(sha, F.sha2(fold_ascii(F.col(text_col)), 256))
    out = rows.join(kept, match, "left_semi")
    return (out.dropDuplicates([id_col, sha]) if repeated else out).drop(sha)
