"""Joins of many rows with a lookup side, safe for hot keys.

AQE splits a hot partition of a join at run time and copies the other side only
for the pieces, but it can do so only when both sides have just been shuffled.
A lookup side made by an aggregation is not: it arrives partitioned by the key
and is joined as it is.  ``salted_join`` adds a salt to the key, which forces a
fresh shuffle of both sides.  Under AQE one salt is enough, nothing is copied
up front, and AQE does the splitting.  Without AQE the many-rows side spreads
every key over several salts, and the lookup side is copied once per salt.

``sketched_join`` finds the hot keys first, by a sketch of frequent items, and salts
only those, each by its share of the rows.  All other rows meet in a plain join: sides
bucketed or partitioned by the key stay where they are.  It reads the many-rows side
once for the sketch and twice for the join, so it is meant for stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATIC_SALTS = 8

# Per shuffle partition: keys that a sketch tracks, and keys that may be called hot.
TRACKED_PER_PARTITION, HOT_PER_PARTITION = 16, 2
MOST_TRACKED = 1_000_000  # Spark's own limit
MERGERS = 256  # sketches of tasks meet in so many groups before they meet in one

_SALT, _COPY = "__salt", "__copy"

Join = Callable[..., DataFrame]


def default_salts(spark: SparkSession) -> int:
    """One where AQE splits hot keys, ``STATIC_SALTS`` elsewhere."""
    needed = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return 1 if all(spark.conf.get(c, "true") == "true" for c in needed) else STATIC_SALTS


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return True


def row_salt(df: DataFrame, salts: int) -> Column:
    """A salt from the row's own content.

    Not a random number: a recomputed task must send its rows to the same place.
    """
    cols = [F.col(f.name) for f in df.schema.fields if _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str,
    null_safe: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """Join ``left`` (many rows per key) with ``right`` (few rows per key).

    ``on`` pairs left with right columns, whose names must differ.  ``how`` is
    inner, left, left_semi or left_anti; the result equals the plain join's.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    n = default_salts(left.sparkSession) if salts is None else salts
    if n == 1:
        # The salt is 0 for every row, but not a constant Spark could fold away.
        many = left.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(m) for m, _ in on]), F.lit(1)).cast("int"))
    else:
        many = left.withColumn(_SALT, row_salt(left, n))
    few = right.withColumn(_COPY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cond = F.col(_SALT) == F.col(_COPY)
    for mine, theirs in on:
        same = F.col(mine).eqNullSafe(F.col(theirs)) if null_safe else F.col(mine) == F.col(theirs)
        cond = cond & same
    return many.join(few, cond, how).drop(_SALT, _COPY)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> dict[int, float]:
    """Hash and share of every key that holds more rows than an average shuffle partition.

    The sketch misses none of them; its shares may be a fifth of a partition too high, so
    slightly cooler keys can be among them.  Sketches have a fixed size, and the driver reads
    at most two hashes per shuffle partition, whatever the table.  Null counts as a key.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    tracked = min(MOST_TRACKED, TRACKED_PER_PARTITION * parts)
    hashes = df.select(F.xxhash64(*[F.col(k) for k in keys]).alias("key"))
    each = hashes.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger")).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch")
    )
    # grouped, as the combining aggregate fails on a task without input
    whole = each.groupBy(F.lit(0).alias("all")).agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    most = min(tracked, HOT_PER_PARTITION * parts)
    found = whole.select("rows", F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top")).collect()
    return {t["item"]: t["count"] / r["rows"] for r in found for t in r["top"] if t["count"] * parts > r["rows"]}


def sketched_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str,
    null_safe: bool = False,
) -> DataFrame:
    """``salted_join`` that salts the hot keys of ``left`` alone; the result is the same.

    A hot key is dealt to twice as many salts as it fills shuffle partitions, and the rows of
    ``right`` with that key are copied once per salt.  ``left`` must give the same rows whenever
    it is read.  Keys whose two columns differ in type, or that Spark cannot hash, are joined by
    ``salted_join``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    types = [(left.schema[m].dataType, right.schema[t].dataType) for m, t in on]
    if any(a.simpleString() != b.simpleString() or not _hashable(a) for a, b in types):
        return salted_join(left, right, on, how, null_safe)

    def same() -> Column:
        pairs = [F.col(m).eqNullSafe(F.col(t)) if null_safe else F.col(m) == F.col(t) for m, t in on]
        out = pairs[0]
        for pair in pairs[1:]:
            out = out & pair
        return out

    mine, theirs = (F.xxhash64(*[F.col(pair[i]) for pair in on]) for i in (0, 1))
    hot = hot_keys(left, [m for m, _ in on])
    if not hot:
        return left.join(right, same(), how)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = F.create_map(*[F.lit(x) for key, share in hot.items() for x in (key, max(2, ceil(2 * share * parts)))])
    plain = left.filter(~mine.isin(list(hot))).join(right, same(), how)
    many = left.filter(mine.isin(list(hot)))
    # rows that are equal in all columns share a salt, so a salt comes from the whole row
    cols = [F.col(f.name) for f in left.schema.fields if _hashable(f.dataType)]
    many = many.withColumn(_SALT, F.pmod(F.xxhash64(F.lit(1), *cols), F.element_at(salts, mine)).cast("int"))
    few = right.filter(theirs.isin(list(hot)))
    few = few.withColumn(_COPY, F.explode(F.sequence(F.lit(0), F.element_at(salts, theirs) - 1)))
    spread = many.join(few, same() & (F.col(_SALT) == F.col(_COPY)), how).drop(_SALT, _COPY)
    return plain.union(spread)
