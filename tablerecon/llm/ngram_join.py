"""Similarity join on word shingles by prefixes under several global orders.

Two sets of similarity ``t`` share a token among the first n - ceil(t n) + 1 of
each, whatever the order of tokens, as long as it is the same for all.  The orders
used here all put tokens of many documents last, by powers of two of their document
frequency, and differ in how they order tokens of one power.

1. Each distinct set of shingles becomes one node; copies are members of it.  The texts
   of an Arrow batch are hashed together, straight from its buffers.
2. Frequencies: tokens are counted in hash ranges.  Tokens above a frequency, which
   is chosen so that their number stays below a fixed bound, are broadcast.
3. First order: prefix postings meet by token.  Documents that no partner in their
   token's list can match, by size or by position in the prefix, leave; lists of the
   same documents become one.
4. Candidate pairs, checked against the prefixes under the other orders, are verified
   on the whole sets.  First every list compares one hub with the rest, so that large
   groups of near copies fall into one component in a few rounds without listing
   their pairs.  Then all pairs of a list that still lie in different components are
   compared.  Pairs inside a component cannot change the components and are not formed.
5. ``class_links`` counts the links of all sets, also those that step 4 passes over:
   the sets of a component meet block by block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, prepare, shuffle_partitions, unused, written
from tablerecon.llm.components import components
from tablerecon.operators.skew import salted_join

WORDS = 5
BUCKET_TOKENS = 2_000_000  # tokens that one counting step holds
BUFFER_TOKENS = 4_000_000  # tokens that a task holds before it hands them on
MAX_COMMON = 500_000  # bound of the broadcast frequency table
RARE = 8  # tokens of up to so many documents are never "common"
HUB_ROUNDS = 12
PAIRS_AT_ONCE = 256  # that a verifying task holds the sets of
BLOCK_SETS = 512  # sets that are compared at once with as many others
BLOCK_TOKENS = 1_000_000
TOKENS_AT_ONCE = 4_096
PAIRS_PER_POSTING = 4  # rounds of hubs go on while more pairs than this are left

# Fixed odd multipliers: of the words of a shingle, of the further orders, of the mixer.
_WORD_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
_ORDER_FACTORS = (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _fixed_stream(n: int, start: int) -> np.ndarray:
    """``n`` well-mixed odd numbers, always the same ones."""
    steps = np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(steps) | np.uint64(1)


_LETTER = bytes(0 if b in b" \t\n\x0b\x0c\r" else 1 for b in range(256))
_LONG = 512  # bytes of a word from which it is hashed on its own
_BY_LENGTH = _mixed(_fixed_stream(_LONG, 1))
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_PIECE_BYTES = 1 << 22  # of texts that are hashed in one go
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in bytes, all words at once."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = at + _PIECE_BYTES
        if end < len(data):
            cut = _SPACES.search(data, end)
            end = cut.start() if cut else len(data)
        out.append(_piece_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if len(out) != 2 else out[1]


def _piece_hashes(data: bytes, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; ``borders`` are places where texts, and so words, begin.

    Eight bytes after the other are mixed into the hash, which begins with the length.
    """
    inside = np.frombuffer(data.translate(_LETTER), bool)
    begins, ends = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=begins[1:])
    np.greater(inside[:-1], inside[1:], out=ends[:-1])
    if borders is not None:
        b = borders[(borders > 0) & (borders < len(data))]
        begins[b], ends[b - 1] = inside[b], inside[b - 1]
    first = np.flatnonzero(begins)
    length = np.flatnonzero(ends) - first + 1
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # from every place on
    h = _BY_LENGTH[np.minimum(length, _LONG) - 1]
    h = _mixed(h ^ (eight[first] & _FIRST_BYTES[np.minimum(length, 8)]))
    more, at = np.flatnonzero((length > 8) & (length < _LONG)), 8
    while len(more):
        left = length[more] - at
        h[more] = _mixed(h[more] ^ (eight[first[more] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    for i in np.flatnonzero(length >= _LONG).tolist():
        word = memoryview(data)[first[i] : first[i] + length[i]]
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h, first


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int = WORDS) -> None:
        self._width = words

    def _totals(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += h[i : i + n] * (_WORD_FACTORS[i % 5] + np.uint64(2 * (i // 5)))
        return _mixed(total)

    def _sets(self, h: np.ndarray, edges: list[int]) -> Iterator[np.ndarray]:
        """Texts are ``h[edges[i]:edges[i + 1]]``."""
        k = self._width
        whole = self._totals(h, k) if len(h) >= k else None
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                yield np.empty(0, np.uint64)
            elif b - a < k:
                yield self._totals(h[a:b], b - a)
            else:
                found = np.sort(whole[a : b - k + 1])
                yield found[_firsts(found)]

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text of a column, many texts at once; null counts as empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, kind)[texts.offset :][: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _PIECE_BYTES, "right")) - 1)
            low = bytes(data[at[i] : at[j]]).lower() if at[j] > at[i] else b""
            if j == i + 1:
                h = word_hashes(low)
                yield from self._sets(h, [0, len(h)])
            else:
                borders = at[i : j + 1] - at[i]
                h, first = _piece_hashes(low, borders)
                yield from self._sets(h, np.searchsorted(first, borders).tolist())
            i = j

    def __call__(self, text: str) -> np.ndarray:
        h = word_hashes(text.encode("utf-8", "surrogatepass").lower())
        return next(self._sets(h, [0, len(h)]))


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node_key(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n + (percent * n) // -100 + 1


class Layout:
    """How tokens are cut into hash ranges: ``bits`` choose the range, ``width`` bytes are kept."""

    def __init__(self, tokens: int, partitions: int) -> None:
        ranges = max(partitions, tokens // BUCKET_TOKENS + 1, 2)
        self.bits = math.ceil(math.log2(ranges))
        self.ranges = 1 << self.bits
        # 13 bits more than needed to tell the tokens apart: one in 8,192 shares its key
        self.width = min(8, max(4, math.ceil((math.log2(tokens + 1) + 13) / 8)))
        self.shift = np.uint64(64 - 8 * self.width)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        return tokens >> self.shift

    def range_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(8 * self.width - self.bits)).astype(np.int64)

    def planes(self, keys: np.ndarray) -> bytes:
        """Keys byte by byte, high bytes first: sorted keys compress well that way."""
        return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - self.width :].T.tobytes()

    def from_planes(self, data: memoryview, n: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, 8 - self.width :] = np.frombuffer(data, np.uint8, n * self.width).reshape(self.width, n).T
        return out.view(">u8").ravel().astype(np.uint64)


def _rows(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_pydict(
        {f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema},
        schema=schema,
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each range, from rows sorted by ``part``."""
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if blob is None:
                continue
            if part != now:
                if held:
                    yield now, held
                now, held = part, []
            held.append(blob)
    if held:
        yield now, held


# --- sets and frequencies


def _count_task(layout: Layout, words: int, id_type: pa.DataType):
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", id_type), ("n", pa.int64()), ("sig", pa.binary()), ("blob", pa.binary())]
    )

    def hand_on(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(layout.keys(np.concatenate(sets)), return_counts=True)
        parts = layout.range_of(keys)
        edges = np.searchsorted(parts, np.arange(layout.ranges + 1))
        for r in range(layout.ranges):
            a, b = int(edges[r]), int(edges[r + 1])
            if a == b:
                continue
            more = np.flatnonzero(counts[a:b] > 1)
            blob = b"".join(
                (
                    np.array([b - a, len(more)], "<u4").tobytes(),
                    layout.planes(keys[a:b]),
                    more.astype("<u4").tobytes(),
                    counts[a:b][more].astype("<u4").tobytes(),
                )
            )
            yield _rows(schema, {"part": [r], "blob": [blob]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        held: list[np.ndarray] = []
        size = 0
        # rows of documents may go anywhere: in turn to all ranges, each task from a place of its own
        turn = 7 * (TaskContext.get().partitionId() if TaskContext.get() else 0)
        for batch in batches:
            n, sigs, parts = [], [], []
            for tokens in shingle.sets(batch.column("text")):
                sig = signature(tokens)
                n.append(len(tokens))
                sigs.append(sig)
                parts.append(turn % layout.ranges)
                turn += 1
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                if size >= BUFFER_TOKENS:
                    yield from hand_on(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int32()),
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.nulls(len(n), pa.binary()),
                ],
                schema=schema,
            )
        if held:
            yield from hand_on(held)

    return task


def _count_merge(layout: Layout, id_type: pa.DataType):
    schema = pa.schema(
        [("doc_id", id_type), ("n", pa.int64()), ("sig", pa.binary()), ("node_key", pa.int64()), ("key", pa.int64()), ("df", pa.int64())]
    )

    def common(blobs: list[bytes]) -> pa.RecordBatch:
        keys, weights = [], []
        for blob in blobs:
            m, e = np.frombuffer(blob, "<u4", 2).tolist()
            view = memoryview(blob)[8:]
            w = np.ones(m, np.int64)
            at = m * layout.width
            w[np.frombuffer(view, "<u4", e, at)] = np.frombuffer(view, "<u4", e, at + 4 * e)
            keys.append(layout.from_planes(view, m))
            weights.append(w)
        k, w = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(k, kind="stable")
        k, w = k[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        df = np.add.reduceat(w, first)
        many = df > RARE
        return _rows(schema, {"key": k[first][many].astype(np.int64), "df": df[many]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[pa.RecordBatch] = []

        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(batch.column("sig").is_valid())
                if own.num_rows:
                    keys = [_node_key(s) for s in own.column("sig").to_pylist()]
                    docs.append(
                        pa.RecordBatch.from_arrays(
                            [own.column("doc_id"), own.column("n"), own.column("sig"), pa.array(keys, pa.int64())]
                            + [pa.nulls(own.num_rows, pa.int64())] * 2,
                            schema=schema,
                        )
                    )
                yield batch

        for _, blobs in _by_range(passing()):
            yield common(blobs)
            yield from docs
            docs.clear()
        yield from docs

    return task


def _ranged(df: DataFrame, layout: Layout) -> DataFrame:
    return df.repartitionById(layout.ranges, "part").sortWithinPartitions("part")


def document_sets(docs: DataFrame, layout: Layout, words: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, sig, node_key)`` per row of ``docs``, and ``(key, df)`` of the common tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    sent = mapped(
        docs, _count_task(layout, words, id_type), f"part int, doc_id {kind}, n bigint, sig binary, blob binary"
    )
    schema = f"doc_id {kind}, n bigint, sig binary, node_key bigint, key bigint, df bigint"
    both = written(mapped(_ranged(sent, layout), _count_merge(layout, id_type), schema), "shingle-sets")
    return (
        both.filter(F.col("sig").isNotNull()).select("doc_id", "n", "sig", "node_key"),
        both.filter(F.col("key").isNotNull()).select("key", "df"),
    )


class Frequencies:
    """Powers of two of the document frequency of the common tokens, at most ``MAX_COMMON`` of them."""

    def __init__(self, common: DataFrame, layout: Layout) -> None:
        power = F.floor(F.log2("df")).cast("int")
        tally = {r["p"]: r["c"] for r in common.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
        least, room = 64, MAX_COMMON
        for p in sorted(tally, reverse=True):
            room -= tally[p]
            if room < 0:
                break
            least = p
        table = common.filter(power >= least).select("key", power.alias("p")).toArrow()
        keys = table.column("key").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], [np.uint64(2**64 - 1)]])
        self.powers = np.concatenate([table.column("p").to_numpy()[order], [0]]).astype(np.uint8)
        self.layout = layout

    def of(self, tokens: np.ndarray) -> np.ndarray:
        keys = self.layout.keys(tokens)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = len(self.keys) - 1
        return np.where(self.keys[at] == keys, self.powers[at], 0)

    def prefix(
        self, tokens: np.ndarray, percent: int, factor: int | None = None, powers: np.ndarray | None = None
    ) -> np.ndarray:
        """The first tokens under an order: by frequency power, then by the hash times ``factor``.

        In this order only where there is no ``factor``.
        """
        p = prefix_length(len(tokens), percent)
        powers = self.of(tokens) if powers is None else powers
        rare = tokens[powers == 0]
        if factor is None:
            return rare[:p] if len(rare) >= p else tokens[np.argsort(powers, kind="stable")[:p]]
        if len(rare) >= p:
            return rare[np.argpartition(rare * np.uint64(factor), p - 1)[:p]]
        return tokens[np.lexsort((tokens * np.uint64(factor), powers))[:p]]


# --- postings of the first order


def _posting_task(layout: Layout, words: int, frequencies, percent: int):
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def hand_on(nodes: list[tuple[int, int]], prefixes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p in prefixes])
        keys = layout.keys(np.concatenate(prefixes))
        owner = np.repeat(np.arange(len(prefixes)), lengths)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        parts = layout.range_of(keys)
        order = np.argsort(parts, kind="stable")
        keys, owner, place, parts = keys[order], owner[order], place[order], parts[order]
        key_of, size_of = np.array([x[0] for x in nodes], np.int64), np.array([x[1] for x in nodes], "<u4")
        edges = np.searchsorted(parts, np.arange(layout.ranges + 1))
        for r in range(layout.ranges):
            a, b = int(edges[r]), int(edges[r + 1])
            if a == b:
                continue
            own, counts = np.unique(owner[a:b], return_counts=True)
            blob = b"".join(
                (
                    np.array([len(own), b - a], "<u4").tobytes(),
                    key_of[own].tobytes(),
                    size_of[own].tobytes(),
                    counts.astype("<u4").tobytes(),
                    layout.planes(keys[a:b]),
                    place[a:b].astype("<u4").tobytes(),
                )
            )
            yield _rows(schema, {"part": [r], "blob": [blob]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(words), frequencies.value
        nodes: dict[int, int] = {}
        prefixes: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for tokens in shingle.sets(batch.column("text")):
                key = _node_key(signature(tokens))
                # a task sends equal sets once
                if not len(tokens) or key in nodes:
                    continue
                prefix = known.prefix(tokens, percent)
                nodes[key] = len(tokens)
                prefixes.append(prefix)
                size += len(prefix)
                if size >= BUFFER_TOKENS:
                    yield from hand_on(list(nodes.items()), prefixes)
                    nodes, prefixes, size = {}, [], 0
        if prefixes:
            yield from hand_on(list(nodes.items()), prefixes)

    return task


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _matchable(run: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Rows that some partner of their run may match: the smallest size allowed decides."""
    order = np.lexsort((n, run))
    sizes = n[order]
    joint = run[order] * (int(n.max()) + 1) + sizes
    need = run * (int(n.max()) + 1) + -(-percent * n // 100)
    at = np.searchsorted(joint, need)
    smallest = sizes[np.minimum(at, len(sizes) - 1)]
    return (100 + percent) * (n - place) >= percent * (n + smallest)


def _posting_merge(layout: Layout, percent: int):
    schema = pa.schema([("list", pa.int64()), ("node_key", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])

    def merged(blobs: list[bytes]) -> pa.RecordBatch | None:
        keys, nodes, sizes, places = [], [], [], []
        for blob in blobs:
            d, m = np.frombuffer(blob, "<u4", 2).tolist()
            at = 8
            key_of = np.frombuffer(blob, np.int64, d, at)
            size_of = np.frombuffer(blob, "<u4", d, at + 8 * d)
            counts = np.frombuffer(blob, "<u4", d, at + 12 * d)
            at += 16 * d
            keys.append(layout.from_planes(memoryview(blob)[at:], m))
            places.append(np.frombuffer(blob, "<u4", m, at + m * layout.width).astype(np.int64))
            nodes.append(np.repeat(key_of, counts))
            sizes.append(np.repeat(size_of, counts).astype(np.int64))
        k, d, n, p = (np.concatenate(x) for x in (keys, nodes, sizes, places))
        order = np.lexsort((p, d, k))
        k, d, n, p = k[order], d[order], n[order], p[order]
        keep = _firsts(k, d)
        for _ in range(2):  # lists of one document, then what the filter leaves alone
            k, d, n, p = k[keep], d[keep], n[keep], p[keep]
            if not len(k):
                return None
            starts = _firsts(k)
            run = np.cumsum(starts) - 1
            keep = np.bincount(run)[run] > 1
            k, d, n, p, run = k[keep], d[keep], n[keep], p[keep], run[keep]
            if not len(k):
                return None
            keep = _matchable(run, n, p, percent)
        k, d, n, p = k[keep], d[keep], n[keep], p[keep]
        if not len(k):
            return None
        starts = np.flatnonzero(_firsts(k))
        run = np.cumsum(_firsts(k)) - 1
        size = np.bincount(run)
        same = _mixed(np.add.reduceat(_mixed(d.view(np.uint64)), starts) + size.astype(np.uint64))
        listed = same[run].view(np.int64)
        keep = size[run] > 1
        listed, d, n, p = listed[keep], d[keep], n[keep], p[keep]
        order = np.lexsort((p, d, listed))
        listed, d, n, p = listed[order], d[order], n[order], p[order]
        first = _firsts(listed, d)
        if not first.any():
            return None
        return _rows(schema, {"list": listed[first], "node_key": d[first], "n": n[first], "place": p[first]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_range(batches):
            out = merged(blobs)
            if out is not None:
                yield out

    return task


def postings(docs: DataFrame, nodes: DataFrame, layout: Layout, words: int, frequencies, percent: int) -> DataFrame:
    """``(list, node, n, place)``: lists of nodes that share a prefix token, equal lists once."""
    sent = mapped(docs, _posting_task(layout, words, frequencies, percent), "part int, blob binary")
    rows = mapped(
        _ranged(sent, layout), _posting_merge(layout, percent), "list bigint, node_key bigint, n bigint, place bigint"
    )
    rows = rows.groupBy("list", "node_key").agg(F.max("n").alias("n"), F.min("place").alias("place"))
    named = nodes.select(F.col("node_key").alias("k"), "node")
    return written(salted_join(rows, named, [("node_key", "k")], "inner").select("list", "node", "n", "place"), "postings")


# --- verification


def _node_texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(node, text)`` of the wanted nodes, one text each."""
    need = wanted.select("node").distinct().join(nodes.select("node", "rep", "sig"), "node")
    rows = docs.join(need, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "sig", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            same = [signature(x) == s for x, s in zip(shingle.sets(batch.column("text")), sigs, strict=True)]
            yield batch.select(["node", "text"]).filter(pa.array(same, pa.bool_()))

    texts = written(mapped(rows, own, "node bigint, text string"), "node-texts")
    repeated = texts.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    return texts if repeated else written(texts.dropDuplicates(["node"]), "node-texts")


def _n_shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sets have in common."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, frequencies, percent: int) -> DataFrame:
    """Those of ``pairs`` ``(u, v)`` that pass the further orders and are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("u_text"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("v_text"))
    rows = salted_join(pairs, two, [("v", "b")], "inner").select("u", "v", "v_text")
    rows = salted_join(rows, one, [("u", "a")], "inner").select("u", "v", "u_text", "v_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(words), frequencies.value

        def linked(some: pa.RecordBatch) -> Iterator[bool]:
            ends = np.concatenate([some.column("u").to_numpy(), some.column("v").to_numpy()])
            texts = pa.concat_arrays([some.column(c).cast(pa.large_string()) for c in ("u_text", "v_text")])
            _, first, place = np.unique(ends, return_index=True, return_inverse=True)
            sets = list(shingle.sets(texts.take(pa.array(first))))
            starts = []
            for tokens in sets:
                powers = known.of(tokens)
                starts.append([known.prefix(tokens, percent, f, powers) for f in _ORDER_FACTORS])
            for i, j in place.reshape(2, -1).T.tolist():
                if all(_n_shared(x, y) for x, y in zip(starts[i], starts[j], strict=True)):
                    a, b = sets[i], sets[j]
                    both = _n_shared(a, b)
                    yield 100 * both >= percent * (len(a) + len(b) - both)
                else:
                    yield False

        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                some = batch.slice(at, PAIRS_AT_ONCE)
                yield some.select(["u", "v"]).filter(pa.array(linked(some), pa.bool_()))

    return written(mapped(rows, check, "u bigint, v bigint"), "links")


def _fits(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Size and position filters of a pair that shares a prefix token."""
    size = F.lit(100) * F.least(n, m) >= percent * F.greatest(n, m)
    return size & (F.lit(100 + percent) * F.least(n - place, m - other) >= percent * (n + m))


def _relabelled(rows: DataFrame, roots: DataFrame | None, column: str) -> DataFrame:
    """``column`` holds nodes; those with a root are replaced by it."""
    if roots is None:
        return rows
    of = roots.select(F.col("node").alias("of"), F.col("root").alias("to"))
    return salted_join(rows, of, [(column, "of")], "left").withColumn(column, F.coalesce("to", column)).drop("of", "to")


def _grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links, which are followed between the components there are."""
    edges = _relabelled(_relabelled(links, roots, "u"), roots, "v")
    found = components(edges)
    if roots is None:
        return written(found, "roots")
    fresh = found.join(roots.select("node"), "node", "left_anti")
    return written(_relabelled(roots, found, "root").unionByName(fresh), "roots")


def _open_lists(rows: DataFrame, round_no: int) -> DataFrame:
    """Rows of lists with more than one component, with the rank that chooses a hub.

    The first hub of a list is the document with the fewest rarer tokens, which edits
    have touched least; later ones are drawn by a hash.
    """
    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(round_no)), 33)
    rank = F.shiftleft(F.col("place"), 31) + draw if round_no == 0 else draw
    rows = rows.withColumn("h", rank)
    lists = rows.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("h").alias("hub"))
    lists = lists.filter("lo < hi").select(F.col("list").alias("l"), "hub")
    return written(salted_join(rows, lists, [("list", "l")], "inner").drop("l"), "open-lists")


def _pairs(left: DataFrame, right: DataFrame, percent: int, ordered: bool) -> DataFrame:
    other = right.select(
        F.col("list").alias("l"), F.col("node").alias("o"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("comp").alias("oc")
    )
    both = salted_join(left, other, [("list", "l")], "inner").filter("comp != oc")
    if ordered:
        both = both.filter("node < o")
    both = both.filter(_fits(F.col("n"), F.col("place"), F.col("m"), F.col("q"), percent))
    return both.select(F.least("node", "o").alias("u"), F.greatest("node", "o").alias("v")).distinct()


def _pairs_left(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of different components within a list."""
    sizes = rows.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("list").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    got = lists.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.lit(0))).first()
    return int(got[0]), int(got[1])


def _link(lists: DataFrame, texts: DataFrame, words: int, frequencies, percent: int) -> DataFrame | None:
    """``(node, root)`` of the nodes that have links; none where no list is left open."""
    rows = lists.withColumn("comp", F.col("node"))
    tested: DataFrame | None = None
    roots: DataFrame | None = None
    before: int | None = None
    for round_no in range(HUB_ROUNDS + 1):
        rows = _open_lists(rows.select("list", "node", "n", "place", "comp"), round_no)
        held, left = _pairs_left(rows)
        if not left:
            break
        # small lists need no hub; hubs that join nothing more do not help
        last = left <= PAIRS_PER_POSTING * held or (round_no > 0 and left > 0.9 * before) or round_no == HUB_ROUNDS
        before = left
        if last:
            pairs = _pairs(rows, rows, percent, ordered=True)
        else:
            pairs = _pairs(rows, rows.filter("h = hub"), percent, ordered=False)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        roots = _grown(roots, _verified(pairs, texts, words, frequencies, percent))
        if last:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        rows = _relabelled(rows.select("list", "node", "n", "place", F.col("node").alias("comp")), roots, "comp")
    return roots


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = 75,
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)``, one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased.  A document's set is its
    distinct ``words``-word shingles, or all its words as one when it has fewer.  Two
    documents link when the sets' intersection is at least ``percent`` of their union.
    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest that
    links lead to.  A text without words, or null, has an empty set and both its own.
    Null ids count as larger than all others; repeated rows keep their rows.  An empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, named, _, _ = _classes(docs, words, percent)
    out = salted_join(rows, named.select("s", "class_id", "component_id"), [("sig", "s")], "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """``(doc_id, n, sig, node_key)`` per row, ``(s, node, class_id, component_id)`` per set, the
    roots of linked sets, and the texts of the sets that may have links."""
    spark = prepare(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    layout = Layout(int(size) // 6, shuffle_partitions(spark))
    rows, common = document_sets(docs, layout, words)
    nodes = rows.filter("n > 0").groupBy("sig", "node_key").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    frequencies = spark.sparkContext.broadcast(Frequencies(common, layout))
    lists = postings(docs, nodes, layout, words, frequencies, percent)
    texts = _node_texts(docs, nodes, lists, words)
    roots = _link(lists, texts, words, frequencies, percent)
    named = nodes.select("sig", "node", "rep")
    if roots is None:
        named = named.withColumn("component_id", F.col("rep"))
    else:
        of = roots.select(F.col("node").alias("r"), "root")
        named = written(named.join(of, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node")).drop("r"), "rooted")
        least = named.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "g")
        named = salted_join(named, least, [("root", "g")], "inner")
    named = written(named.select(F.col("sig").alias("s"), "node", F.col("rep").alias("class_id"), "component_id"), "classes")
    return rows, named, roots, texts


def _linked_block(left: list[dict], right: list[dict] | None, shingle: Shingler, percent: int) -> Iterator[tuple[int, int, int]]:
    """``(node, linked sets, documents of them)`` from all pairs of two blocks, or within one."""
    one, two = (list(shingle.sets(pa.array([x["text"] for x in side], pa.large_string()))) for side in (left, right or []))
    if right is None:
        two = one
    known, rows, cols = [], [], []
    for sets in (one, two):
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        known.append(tokens)
        cols.append(at)
        rows.append(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    shared, ia, ib = np.intersect1d(*known, assume_unique=True, return_indices=True)
    places = []
    for k, i in enumerate((ia, ib)):
        place = np.full(len(known[k]), -1, np.int64)
        place[i] = np.arange(len(shared))
        at = place[cols[k]]
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0) :]
        places.append((at[order], rows[k][order]))
    both = np.zeros((len(one), len(two)), np.int64)
    for lo in range(0, len(shared), TOKENS_AT_ONCE):  # so many shared tokens at once
        grids = []
        for (at, row), n in zip(places, (len(one), len(two)), strict=True):
            a, b = np.searchsorted(at, [lo, lo + TOKENS_AT_ONCE])
            grid = np.zeros((n, min(TOKENS_AT_ONCE, len(shared) - lo)), np.float32)
            grid[row[a:b], at[a:b] - lo] = 1
            grids.append(grid)
        both += (grids[0] @ grids[1].T).astype(np.int64)  # whole numbers, exact
    n, m = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    linked = 100 * both >= percent * (n[:, None] + m[None, :] - both)
    if right is None:
        np.fill_diagonal(linked, False)
    sides = [(left, linked, left if right is None else right)]
    if right is not None:
        sides.append((right, linked.T, left))
    for own, grid, others in sides:
        sets, found = grid.sum(1).tolist(), (grid @ np.array([x["size"] for x in others], np.int64)).tolist()
        yield from ((x["node"], a, b) for x, a, b in zip(own, sets, found, strict=True) if a)


def _link_counts(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(node, n_linked, n_links)`` of ``(node, root, n, size)``: every pair of a component, in blocks.

    A component's sets are dealt into blocks of bounded size by a hash, apart by powers
    of the size ratio that links allow, so that only blocks of the same or the next power
    meet.  A row is a pair of blocks, never a pair of sets.
    """
    # a little above the ratio, so that rounding never puts linked sets two powers apart
    power = F.floor(F.log("n") / F.lit(math.log(100 / percent * 1.001))).cast("int")
    members = members.withColumn("power", power)
    tally = members.groupBy("root", "power").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    parts = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("t") / BLOCK_TOKENS)).cast("int")
    tally = written(tally.select("root", "power", parts.alias("parts")), "block-tally")
    of = tally.select(F.col("root").alias("r"), F.col("power").alias("p"), "parts")
    dealt = salted_join(members, of, [("root", "r"), ("power", "p")], "inner")
    dealt = dealt.select("node", "size", "root", "power", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    dealt = salted_join(dealt, texts.select(F.col("node").alias("t"), "text"), [("node", "t")], "inner")
    entry = F.struct("node", "size", "text")
    blocks = written(dealt.groupBy("root", "power", "part").agg(F.collect_list(entry).alias("sets")), "blocks")
    # partners of a block: itself, later ones of its power, all of the next power
    up = tally.select(F.col("root").alias("r"), (F.col("power") - 1).alias("p"), F.col("parts").alias("more"))
    ids = tally.join(up, (F.col("root") == F.col("r")) & (F.col("power") == F.col("p")), "left").select("root", "power", "parts", "more")
    ids = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = F.array().cast("array<int>")
    later = F.when(F.col("part") + 1 < F.col("parts"), F.sequence(F.col("part") + 1, F.col("parts") - 1)).otherwise(none)
    above = F.when(F.col("more") > 0, F.sequence(F.lit(0), F.col("more") - 1)).otherwise(none)
    with_power = lambda step: lambda x: F.struct((F.col("power") + step).alias("power"), x.alias("part"))
    partner = F.explode(F.concat(F.transform(later, with_power(0)), F.transform(above, with_power(1))))
    pairs = ids.select("root", "power", "part", partner.alias("o")).select(
        "root", "power", "part", F.col("o.power").alias("power2"), F.col("o.part").alias("part2")
    )
    key = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("root", "power", "part")]
    right = blocks.select(*key("b"), F.col("sets").alias("right"))
    left = blocks.select(*key("a"), F.col("sets").alias("left"))
    pairs = salted_join(pairs, right, [("root", "root_b"), ("power2", "power_b"), ("part2", "part_b")], "inner")
    pairs = salted_join(pairs, left, [("root", "root_a"), ("power", "power_a"), ("part", "part_a")], "inner").select("left", "right")
    alone = blocks.filter(F.size("sets") > 1).select(F.col("sets").alias("left"), F.lit(None).cast(blocks.schema["sets"].dataType).alias("right"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        held: dict[int, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, *v) for k, v in held.items()]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "n_linked", "n_links"])

        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].as_py() for c in ("left", "right"))
                for node, a, b in _linked_block(left, right, shingle, percent):
                    v = held.setdefault(node, [0, 0])
                    v[0] += a
                    v[1] += b
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    counted = mapped(alone.unionByName(pairs), count, "node bigint, n_linked bigint, n_links bigint")
    return written(counted.groupBy("node").agg(F.sum("n_linked").alias("n_linked"), F.sum("n_links").alias("n_links")), "link-counts")


def class_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75
) -> DataFrame:
    """``(class_id, class_size, component_id, n_linked_classes, n_links)``, one row per distinct set.

    The join that ``near_duplicates`` follows, counted: ``n_linked_classes`` other classes
    link with the class, and ``n_links`` documents in them with each of its documents.
    Documents of one class link with each other and are not counted.  No link is left
    out, also where hubs had joined the component before.  Texts without words have no
    class; null ids and repeated rows count as rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, named, roots, texts = _classes(docs, words, percent)
    sizes = rows.filter("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"))
    sets = written(named.join(sizes, F.col("s") == F.col("sig")).drop("s", "sig"), "class-sizes")
    zero = F.lit(0).cast("long")
    if roots is None:
        found = sets.withColumns({"n_linked": zero, "n_links": zero})
    else:
        members = roots.join(sets.select(F.col("node").alias("x"), "n", "size"), F.col("node") == F.col("x")).drop("x")
        counts = _link_counts(members, texts, words, percent).withColumnRenamed("node", "y")
        found = sets.join(counts, F.col("node") == F.col("y"), "left")
    return found.select(
        "class_id",
        F.col("size").alias("class_size"),
        "component_id",
        F.coalesce("n_linked", zero).alias("n_linked_classes"),
        F.coalesce("n_links", zero).alias("n_links"),
    )


def one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, columns unchanged.

    Where ids are null or repeated, rows are told apart by a number of their own.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("i"))
    unclear = ids.groupBy("i").agg(F.count(F.lit(1)).alias("c")).filter("i IS NULL OR c > 1")
    own = id_col
    if not unclear.isEmpty():
        own = unused(docs, "__row")
        docs = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs, own, text_col, words, percent)
    keep = unused(docs, "keep")
    kept = written(found.filter("doc_id = component_id").select(F.col("doc_id").alias(keep)), "kept-ids")
    out = docs.join(kept, F.col(own) == F.col(keep), "left_semi")
    return out if own == id_col else out.drop(own)
