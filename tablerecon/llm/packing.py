"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

1. Documents become pieces of at most ``capacity`` tokens.
2. Pieces are dealt round-robin over partitions of a bounded number of pieces.
   Each partition is packed best-fit decreasing, and dual feasible functions bound
   from below the number of bins its pieces need.
3. Where count and bound agree, the partition is certified and its bins are final,
   but for its emptiest one.  Partitions with a gap give up every bin that has room.
   These pieces, from all partitions, are dealt anew and packed again.  A round that
   does not need fewer bins than before is not taken, and ends the exchange.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, text_column, written
from tablerecon.llm.tokens import encoder

END_ID = 2
CAPACITY = 1024
PARTITION_PIECES = 50_000
ROUNDS = 4


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: full ones, the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the token ids of every document, cut.

    ``ids`` are little-endian unsigned 32-bit numbers.  A null or empty text is the
    end id alone; repeated rows give repeated pieces; null ids stay null.
    """
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids binary" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_batch
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, ids_of in enumerate(encode(text_column(batch))):
                whole = ids_of + end
                for k, (s, n) in enumerate(cut(len(whole) // 4, capacity)):
                    part = whole[4 * s : 4 * (s + n)]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenize, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit for lengths in descending order: bin and offset of each, and the room left per bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set while some bin has room r
    room: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = open_rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = r - n
        room[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    ``f_t`` rounds lengths above ``capacity - t`` up to the capacity and drops those
    below ``t``; ``u_k`` rounds ``(k + 1) x / capacity`` down unless it is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(counts * x)])  # below[t]: total of lengths under t
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # above[t]: how many from t on
    best = 0
    for t in range(capacity // 2 + 1):
        large = above[capacity - t + 1]
        middle = below[capacity - t + 1] - below[t]
        best = max(best, int(large + -(-int(middle) // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        u = np.where(whole, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * u).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, round_no: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        keys = [(c, "ascending") for c in ("start", "ids_crc32", "doc_id")]
        table = table.sort_by([("length", "descending"), *keys])
        lengths = table.column("length").to_numpy()
        part = TaskContext.get().partitionId()
        bins, offsets, room = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if len(room) > bound:
            give = room > 0
        else:
            give = np.zeros(len(room), bool)
            give[room.argmax()] = room.max() > 0
        n = len(lengths)
        table = table.append_column("sequence_id", pa.array((round_no << 56) + (part << 28) + bins))
        table = table.append_column("offset", pa.array(offsets))
        table = table.append_column("open", pa.array(give[bins]))
        table = table.append_column("part", pa.array(np.full(n, part, np.int64)))
        table = table.append_column("bins", pa.array(np.full(n, len(room), np.int64)))
        table = table.append_column("bound", pa.array(np.full(n, bound, np.int64)))
        yield from table.to_batches(max_chunksize=10_000)

    return pack


def _round(rows: DataFrame, n: int, capacity: int, round_no: int, per_partition: int) -> tuple[DataFrame, int]:
    parts = max(1, math.ceil(n / per_partition))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = fields + ", sequence_id bigint, offset bigint, open boolean, part bigint, bins bigint, bound bigint"
    packed = mapped(rows.repartition(parts), _packer(capacity, round_no), schema)
    return written(packed, f"pack-{round_no}"), parts


def best_fit_pack(
    rows: DataFrame, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES, rounds: int = ROUNDS
) -> DataFrame:
    """``rows`` of :func:`pieces` with ``sequence_id`` and ``offset``, in as few sequences as it can.

    Further columns of ``rows``, such as ``ids``, are carried along.  Equal rows are
    interchangeable and each gets a place of its own.  An empty table stays empty.
    """
    columns = rows.columns
    rows = written(rows, "pieces")
    final: list[DataFrame] = []
    total = rows.count()
    packed, parts = _round(rows, total, capacity, 0, per_partition)
    round_no = 0
    while parts > 1 and round_no + 1 < rounds:
        given = packed.filter("open")
        final.append(packed.filter("not open"))
        before = given.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        round_no += 1
        again, parts = _round(given.select(*columns), before[0], capacity, round_no, per_partition)
        after = again.select("part", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
        if after >= before[1]:
            packed = given
            break
        packed = again
    final.append(packed)
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids, offsets)``: the packed sequences themselves.

    ``packed`` must carry ``ids``.  A sequence gathers at most its capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    join = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return whole.select(
        "sequence_id",
        join.alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
