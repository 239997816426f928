"""Table digests and the stale check.

A table digest is built from per-row SHA-256 hashes by sums, so partial
aggregation does nearly all the work and no task ever holds more than a fixed
number of rows of it.  It does not depend on row order or partitioning, and one
changed, missing or extra row changes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.hashing import row_hash

# Row hashes fall into 256 buckets by their first two hex digits.  Four pieces
# of 14 digits are summed as two halves of 28 bits each: a bucket's sum stays
# below 2^63 up to 2^35 rows, about 8.8e12 rows per table.
BUCKET_DIGITS = 2
PIECES = 4
PIECE_DIGITS = 14
HALF_BITS = 28

SUM_COLUMNS = [f"{half}{i}" for i in range(PIECES) for half in ("hi", "lo")]


def _piece(hashed: Column, i: int) -> Column:
    return F.conv(F.substring(hashed, 1 + i * PIECE_DIGITS, PIECE_DIGITS), 16, 10).cast("long")


def bucket_sums(hashes: DataFrame, hash_col: str = "row_hash", by: Sequence[str] = ()) -> DataFrame:
    """``(bucket, rows, hi0, lo0 ... hi3, lo3)``, at most 256 rows; ``by`` adds columns to the groups."""
    h = F.col(hash_col)
    pieces = hashes.select(
        *by,
        F.substring(h, 1, BUCKET_DIGITS).alias("bucket"),
        *[_piece(h, i).alias(f"p{i}") for i in range(PIECES)],
    )
    sums = []
    for i in range(PIECES):
        sums.append(F.sum(F.shiftright(f"p{i}", HALF_BITS)).alias(f"hi{i}"))
        sums.append(F.sum(F.col(f"p{i}").bitwiseAND(F.lit((1 << HALF_BITS) - 1))).alias(f"lo{i}"))
    return pieces.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("rows"), *sums)


def shift_sums(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Bucket sums after rows came and went.

    Sums are linear, so a table's new digest needs its changes only, not
    another pass over the table.  Buckets that become empty drop out.
    """
    cols = ["rows", *SUM_COLUMNS]
    minus = removed.select("bucket", *[(-F.col(c)).alias(c) for c in cols])
    every = base.select("bucket", *cols).unionByName(added.select("bucket", *cols)).unionByName(minus)
    return every.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).filter("rows <> 0")


def _lines(sums: DataFrame) -> DataFrame:
    line = F.concat_ws(":", "bucket", *[F.col(c).cast("string") for c in ("rows", *SUM_COLUMNS)])
    return sums.withColumn("bucket_digest", F.sha2(line, 256))


def bucket_digests(hashes: DataFrame, hash_col: str = "row_hash") -> DataFrame:
    """``(bucket, rows, bucket_digest)``, at most 256 rows."""
    return _lines(bucket_sums(hashes, hash_col)).select("bucket", "rows", "bucket_digest")


def _header(meta: Mapping[str, object]) -> str:
    return ",".join(f"{k}={meta[k]}" for k in sorted(meta))


def hashed_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    sets: Sequence[str] = (),
) -> DataFrame:
    """One column ``row_hash``; see ``table_digest`` for the options."""
    names = [c for c in (columns or df.columns) if c not in set(exclude)]
    view = df.select(*[F.sort_array(c).alias(c) if c in sets else F.col(c) for c in names])
    return view.select(row_hash(view).alias("row_hash"))


def digest_of(
    sums: DataFrame, meta: Mapping[str, object] | None = None, keep: bool = False
) -> DataFrame:
    """One row ``(rows, digest)`` from bucket sums; ``keep`` adds the sums as a list."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "bucket_digest")))
    body = F.concat(F.lit(_header(meta or {}) + "\n"), F.array_join(lines, "\n"))
    out = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(body, 256).alias("digest")]
    if keep:
        out.append(F.collect_list(F.struct("bucket", "rows", *SUM_COLUMNS)).alias("sums"))
    return _lines(sums).agg(*out)


def digest_text(sums: Mapping[str, Sequence[int]], meta: Mapping[str, object]) -> str:
    """The digest of ``digest_of`` from at most 256 bucket sums in memory."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    lines = [f"{b}:{sha(':'.join([b, *map(str, s)]))}" for b, s in sums.items()]
    return sha(_header(meta) + "\n" + "\n".join(sorted(lines)))


def table_digest(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    sets: Sequence[str] = (),
    meta: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row ``(rows, digest)`` over the table's content and ``meta``.

    ``exclude`` leaves out columns such as timestamps; ``sets`` names list
    columns whose order does not matter.
    """
    return digest_of(bucket_sums(hashed_rows(df, columns, exclude, sets)), meta)


def config_digest(
    desired: DataFrame, ignore: Sequence[str] = ("depends_on",), **kw
) -> DataFrame:
    """Digest of desired rows without dependency columns.

    A null, which means "not managed" on the desired side, hashes like any
    other value: it differs from every value and equals only another null.
    """
    return table_digest(desired, exclude=ignore, **kw)


def is_stale(saved: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``(stale, reason)`` from two one-row ``(lineage, serial, digest)``.

    Lineage, serial and digest are compared in this order; the first that
    moved is the reason.
    """
    both = saved.select(F.lit("saved").alias("side"), "lineage", "serial", "digest").unionByName(
        current.select(F.lit("current").alias("side"), "lineage", "serial", "digest")
    )

    def side(name: str, col: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(col)))

    reason = F.lit(None).cast("string")
    for col in ("digest", "serial", "lineage"):
        moved = ~side("saved", col).eqNullSafe(side("current", col))
        reason = F.when(moved, F.lit(f"{col} changed")).otherwise(reason)
    return both.agg(reason.alias("reason")).select(F.col("reason").isNotNull().alias("stale"), "reason")
