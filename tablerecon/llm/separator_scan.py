"""Token counts per document of flat token streams, found by scanning for separators.

A flat stream is token ids one after another, each document closed by an end id,
without any index.  It is kept as blocks of equal length, cut without regard to
documents.  Every block is searched on its own, vectorised; a document that runs
over block borders is stitched by a prefix scan over small block summaries: how
many documents ended before the block, and how many tokens have passed since the
last end.  The scan has two levels, so that no task holds all blocks of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, prepare, text_column, written
from tablerecon.llm.tokens import encoder

END_OF_DOCUMENT = 50_256
BLOCK_TOKENS = 65_536
GROUP_BLOCKS = 1_024


def _width(end_id: int, vocabulary_size: int) -> str:
    return "<u2" if max(end_id + 1, vocabulary_size) <= 65_536 else "<u4"


def flat_streams(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_OF_DOCUMENT,
    vocabulary_size: int = 50_257,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Tokenize ``docs`` into flat streams, one per task: blocks and manifest.

    Blocks: ``(stream, block, data)``.  Manifest: ``(stream, ordinal, doc_id)``, which
    document is the n-th of its stream.  Both are written to the shared folder in one
    pass and read back, so that they always belong together.  A null or empty text is
    an end id alone.
    """
    kind = docs.schema[id_col].dataType
    schema = f"stream bigint, block bigint, data binary, ordinal bigint, doc_id {kind.simpleString()}"
    dtype = _width(end_id, vocabulary_size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added_tokens=False).encode_batch
        stream, block, ordinal = TaskContext.get().partitionId(), 0, 0
        size = block_tokens * np.dtype(dtype).itemsize
        end = np.array([end_id], dtype).tobytes()
        rest = bytearray()

        def blocks(data: list[bytes], ids: pa.Array, first: int) -> pa.RecordBatch:
            m, n = len(data), len(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "stream": pa.array([stream] * (m + n), pa.int64()),
                    "block": pa.array([*range(block, block + m), *[None] * n], pa.int64()),
                    "data": pa.array([*data, *[None] * n], pa.binary()),
                    "ordinal": pa.array([*[None] * m, *range(first, first + n)], pa.int64()),
                    "doc_id": pa.concat_arrays([pa.nulls(m, ids.type), ids]),
                }
            )

        none = None
        for batch in batches:
            data = []
            for ids_of in encode(text_column(batch)):
                rest += np.frombuffer(ids_of, "<u4").astype(dtype).tobytes()
                rest += end
                while len(rest) >= size:
                    data.append(bytes(rest[:size]))
                    del rest[:size]
            ids = batch.column("doc_id")
            none = ids[:0]
            yield blocks(data, ids, ordinal)
            block += len(data)
            ordinal += len(ids)
        if rest:
            yield blocks([bytes(rest)], none, ordinal)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = written(mapped(rows, write, schema), "flat-streams")
    return (
        both.filter(F.col("block").isNotNull()).select("stream", "block", "data"),
        both.filter(F.col("ordinal").isNotNull()).select("stream", "ordinal", "doc_id"),
    )


def read_flat_files(
    spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2"
) -> DataFrame:
    """Blocks of raw token files; ``stream`` is the file's path.

    One task cuts one file, which Spark's binary source limits to 2 GB.
    """
    size = block_tokens * np.dtype(dtype).itemsize
    files = prepare(spark).read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "content")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / size).cast("int"))
    return files.filter(F.octet_length("content") > 0).select(
        "stream",
        F.posexplode(F.transform(starts, lambda i: F.substring("content", i * size + 1, F.lit(size)))).alias("block", "data"),
    )


def _summaries(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    kind = blocks.schema["stream"].dataType.simpleString()
    schema = f"stream {kind}, block bigint, n_tokens bigint, ends array<int>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column("data").to_pylist():
                tokens = np.frombuffer(data or b"", dtype)
                n.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id).astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "stream": batch.column("stream"),
                    "block": batch.column("block").cast(pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ends": pa.array(ends, pa.list_(pa.int32())),
                }
            )

    return mapped(blocks.select("stream", "block", "data"), search, schema)


def _before(part: list[str], order: str):
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def token_counts(
    blocks: DataFrame,
    end_id: int = END_OF_DOCUMENT,
    dtype: str = "<u2",
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """``(stream, ordinal, start, n_tokens, closed)``: the documents of each stream in order.

    ``n_tokens`` leaves out the end id.  Tokens after a stream's last end are a last
    document with ``closed`` false.  Empty blocks and an empty table are allowed; blocks
    must be numbered in order within a stream, each number once.
    """
    zero = F.lit(0).cast("bigint")
    found = written(_summaries(blocks, end_id, dtype), "separators")
    local = found.select(
        "stream",
        "block",
        F.floor(F.col("block") / group_blocks).alias("grp"),
        "n_tokens",
        F.size("ends").cast("bigint").alias("n_ends"),
        F.get("ends", F.size("ends") - 1).cast("bigint").alias("last_end"),
    )
    inner = _before(["stream", "grp"], "block")
    local = local.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(inner), zero).alias("in_group"),
        F.coalesce(F.sum("n_ends").over(inner), zero).alias("ends_in_group"),
    )
    local = local.withColumn("end_in_group", F.col("in_group") + F.col("last_end"))
    local = local.withColumn("prior_end", F.max("end_in_group").over(inner))
    groups = local.groupBy("stream", "grp").agg(
        F.sum("n_tokens").alias("g_tokens"), F.sum("n_ends").alias("g_ends"), F.max("end_in_group").alias("g_last")
    )
    outer = _before(["stream"], "grp")
    groups = groups.select(
        "*",
        F.coalesce(F.sum("g_tokens").over(outer), zero).alias("base"),
        F.coalesce(F.sum("g_ends").over(outer), zero).alias("base_ends"),
    )
    groups = groups.withColumn("abs_last", F.col("base") + F.col("g_last"))
    groups = groups.withColumn("base_end", F.coalesce(F.max("abs_last").over(outer), zero - 1))
    carried = local.join(groups.select("stream", "grp", "base", "base_ends", "base_end"), ["stream", "grp"]).select(
        "stream",
        "block",
        (F.col("base") + F.col("in_group")).alias("at"),
        (F.col("base_ends") + F.col("ends_in_group")).alias("first_ordinal"),
        F.coalesce(F.col("base") + F.col("prior_end"), F.col("base_end")).alias("open_end"),
    )
    whole = found.join(carried, ["stream", "block"])
    rows = whole.select(
        "stream", "at", "first_ordinal", "open_end", "ends", F.posexplode("ends").alias("i", "end")
    )
    previous = F.when(F.col("i") == 0, F.col("open_end")).otherwise(
        F.col("at") + F.get("ends", F.col("i") - 1)
    )
    closed = rows.select(
        "stream",
        (F.col("first_ordinal") + F.col("i")).alias("ordinal"),
        (previous + 1).alias("start"),
        (F.col("at") + F.col("end") - previous - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tails = groups.groupBy("stream").agg(
        F.sum("g_tokens").alias("n"), F.sum("g_ends").alias("ordinal"), F.coalesce(F.max("abs_last"), zero - 1).alias("last")
    )
    tails = tails.filter("n > last + 1").select(
        "stream", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(tails)


def document_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``(doc_id, stream, ordinal, start, n_tokens)``, one row per input row.

    Documents are written as flat streams, the streams are scanned, and the manifest
    names the documents.  Null texts have no tokens; null and repeated ids keep their rows.
    """
    blocks, manifest = flat_streams(docs, vocabulary, id_col, text_col, block_tokens=block_tokens)
    counts = token_counts(blocks)
    return manifest.join(counts, ["stream", "ordinal"], "left").select(
        "doc_id", "stream", "ordinal", "start", "n_tokens"
    )
