"""Near-duplicate classes by SetSketch registers.

A SetSketch register holds the rounded-down logarithm of the smallest of exponential
random values, one value per shingle.  Registers of a union are the maxima of the parts'
registers, and two sets agree in a register with a probability close to their Jaccard
similarity.

1. Sketch: a task walks through the arrival times of one Poisson process per shingle, all
   shingles of many texts at once; arrivals fall on random registers.  Shingles leave as
   soon as their time is past the largest minimum of their text.
2. Bands: ``ROWS`` registers in a row are one key; sets that share a key are candidates.
   At the similarity asked for, a pair misses all ``BANDS`` keys with a probability of
   (1 - J**ROWS)**BANDS: 5e-8 at 0.8.
3. Stars: each bucket compares one hub, its smallest node, with the rest.  Of the counts of
   larger, smaller and equal registers the joint likelihood is taken; pairs stay unless the
   similarity asked for is ``exp(-SURE)`` times less likely than a smaller one (of linked
   pairs 1e-8 are lost).  The others are verified on the whole sets of both texts.
4. Families: the other members of a bucket are compared inside tasks, by the parity of the
   registers, in blocks of bounded size; who is not clearly apart belongs to one family.  A
   bucket gives a spanning forest of families, never its pairs.
5. Blocks: a family's texts meet block by block.  In a task, pairs of different components
   that share a band are estimated by their likelihood and verified on their whole sets;
   out come the links that join components, again a forest.

Sets are compared as 64-bit hashes; two different shingles of a pair agree in hash with a
probability of about 1e-13 for texts of a thousand words.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, prepare, text_column, written
from tablerecon.llm.components import components
from tablerecon.llm.ngram_join import Shingler
from tablerecon.operators.skew import salted_join

WORDS, PERCENT = 2, 80
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1  # spacing of registers, rate of arrivals, largest register
SURE = 16.0
BITS_APART = 40  # of 128 parity bits; linked pairs differ in more with a probability below 1e-10
BUCKET_SETS = 1_024  # of a bucket that meet as many others in one task
BLOCK_SETS, BLOCK_CHARS = 512, 4_000_000  # of a family
TOKENS_AT_ONCE, SETS_AT_ONCE = 400_000, 2_048
SETS_KEPT = 64  # sets that a verifying task remembers
_GRID = 16  # similarities at which the likelihood is compared; between two of them it differs by 0.2 at most

# Fixed odd multipliers of the arrival stream.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest arrival time per set and register; times of one shingle have rate ``RATE``."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.inf)
    time = np.zeros(len(tokens))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(tokens):
            step += np.uint64(1)
            r = _mixed(tokens + step * _STEP)
            time -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * REGISTERS)
            np.minimum.at(least, owner * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64), time)
            alive = time < least.reshape(-1, REGISTERS).max(axis=1)[owner]
            tokens, owner, time = tokens[alive], owner[alive], time[alive]
    return least.reshape(-1, REGISTERS)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of non-empty sets of 64-bit hashes, one row per set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))  # sets of like size need like many steps
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or (size < TOKENS_AT_ONCE and end - at < SETS_AT_ONCE)):
            size += len(sets[order[end]])
            end += 1
        some = order[at:end]
        times = _minima([sets[i] for i in some])
        out[some] = np.clip(np.floor(1 - np.log(times) / math.log(BASE)), 0, TOP).astype(np.uint16)
        at = end
    return out


def merged(*registers: np.ndarray) -> np.ndarray:
    """Registers of the union of sets: the larger ones."""
    return np.maximum.reduce(registers)


def _larger(share: np.ndarray) -> np.ndarray:
    """Probability that one set's register is larger, where ``share`` of the union is its own."""
    return -np.log1p(-share * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(
    more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray
) -> np.ndarray:
    """Of a similarity, given how many registers of a are larger and smaller than those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _larger(np.maximum(u - v * similarity, 0)), _larger(np.maximum(v - u * similarity, 0))
    tiny = 1e-300
    equal = np.maximum(1 - p - q, 0)
    term = lambda count, chance: np.where(count > 0, count * np.log(np.maximum(chance, tiny)), 0.0)
    return term(more, p) + term(less, q) + term(REGISTERS - more - less, equal)


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs' registers leave a similarity of ``percent`` likely enough."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - more - less
    # of linked pairs with so few equal registers there is one in 1e12; with so many the estimate is no lower
    few, many = 200 * equal < percent * REGISTERS, 100 * equal >= percent * REGISTERS
    out = many & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    unclear = np.flatnonzero(~few & ~many)
    out[unclear] = _likely(more[unclear], less[unclear], n_a[unclear], n_b[unclear], percent)
    return out


def _likely(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    best = np.full(len(more), -np.inf)
    for j in np.linspace(0, percent / 100, _GRID, endpoint=False):
        best = np.maximum(best, log_likelihood(more, less, n_a, n_b, j))
    # up to the largest similarity the sizes allow; beyond the one asked for it grows or falls once
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    here = log_likelihood(more, less, n_a, n_b, np.minimum(percent / 100, most))
    return fits & (here >= best - SURE)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketch_task(words: int, least: int, id_type: pa.DataType):
    schema = pa.schema(
        [("doc_id", id_type), ("content", pa.binary()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
        + [("b1", pa.int64()), ("b2", pa.int64()), ("registers", pa.binary())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            sigs = np.zeros((batch.num_rows, 2), np.int64)
            bits = np.zeros((batch.num_rows, 2), np.int64)
            registers: list[bytes | None] = [None] * batch.num_rows
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def sketch() -> None:
                found = sketches([s for _, s in held])
                parity = np.packbits((found & 1).astype(np.uint8), axis=1)
                for (i, _), row, bit in zip(held, found, parity, strict=True):
                    registers[i] = row.astype("<u2").tobytes()  # noqa: B023
                    bits[i] = bit.view(np.int64)  # noqa: B023

            for i, text in enumerate(text_column(batch)):
                tokens = shingle(text)
                n[i], sigs[i] = len(tokens), _signature(tokens)
                if len(tokens) >= least:
                    held.append((i, tokens))
                    size += len(tokens)
                if size >= 4 * TOKENS_AT_ONCE:
                    sketch()
                    held, size = [], 0
            if held:
                sketch()
            values = [n, sigs[:, 0], sigs[:, 1], bits[:, 0], bits[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content")]
                + [pa.array(np.ascontiguousarray(v)) for v in values]
                + [pa.array(registers, pa.binary())],
                schema=schema,
            )

    return task


def smallest_partner(percent: int) -> int:
    """Sets of fewer shingles link with equal sets only."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _estimate(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(a, b, content_a, content_b)`` of the pairs that may link."""
    side = lambda x: nodes.select(
        F.col("node").alias(f"node_{x}"),
        F.col("n").alias(f"n_{x}"),
        F.col("registers").alias(f"registers_{x}"),
        F.col("content").alias(f"content_{x}"),
    )
    both = salted_join(pairs, side("a"), [("a", "node_a")], "inner")
    both = salted_join(both, side("b"), [("b", "node_b")], "inner")
    out = ["a", "b", "content_a", "content_b"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [
                np.frombuffer(b"".join(batch.column(f"registers_{x}").to_pylist()), "<u2").reshape(-1, REGISTERS)
                for x in "ab"
            ]
            sizes = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            yield batch.filter(pa.array(may_link(*rows, *sizes, percent))).select(out)

    return mapped(both.drop("node_a", "node_b"), task, "a bigint, b bigint, content_a binary, content_b binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(content, text)`` of the wanted contents, each once."""
    found = salted_join(docs, wanted.distinct(), [("content", "w")], "left_semi")
    return written(found.select("content", "text").dropDuplicates(["content"]), "sketch-texts")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    side = lambda x: texts.select(F.col("content").alias(f"k_{x}"), F.col("text").alias(f"text_{x}"))
    both = salted_join(pairs, side("a"), [("content_a", "k_a")], "inner")
    both = salted_join(both, side("b"), [("content_b", "k_b")], "inner")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def tokens(node: int, batch: pa.RecordBatch, side: str, i: int) -> np.ndarray:
            if node not in kept:
                kept[node] = shingle(batch.column(f"text_{side}")[i].as_py())
                if len(kept) > SETS_KEPT:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            linked = []
            nodes = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            for i, (a, b) in enumerate(nodes):
                x, y = tokens(a, batch, "a", i), tokens(b, batch, "b", i)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"]).rename_columns(["u", "v"])

    return mapped(both.select("a", "b", "text_a", "text_b"), task, "u bigint, v bigint")


def _with_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    of = roots.select(F.col("node").alias("x"), F.col("root").alias("r"))
    return salted_join(rows, of, [("node", "x")], "left").withColumn("root", F.coalesce("r", "node")).drop("x", "r")


def _merged_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return written(components(links), "sketch-roots")


def _first_pairs(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several sets, without the hub, and the hub's pairs."""
    hubs = postings.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    hubs = hubs.filter("hub < last").select(F.col("bucket").alias("k"), "hub")
    rows = salted_join(postings, hubs, [("bucket", "k")], "inner").filter("node > hub")
    rows = written(rows.select("bucket", "node", "hub"), "sketch-buckets")
    return rows.select("bucket", "node"), rows.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _block_pairs(rows: DataFrame, key: str, parts: Column, columns: list[str]) -> DataFrame:
    """Rows dealt into ``parts`` per key, each once for every pair of parts ``(p, q)`` that its own
    part belongs to, and brought together by pair."""
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    pair = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    rows = rows.select(F.col(key).alias("key"), *pair, "own", *columns)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut where ``(key, p, q)`` changes, so that no group is torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
        last = np.flatnonzero((ids != ids[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("key", "p", "q"))
        if held and (cut or not same):
            first = batch.slice(0, cut) if same else batch.slice(0, 0)
            yield pa.Table.from_batches([*held, first])
            held = []
            if not same and cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table) -> np.ndarray:
    """The number of each row's group."""
    ids = np.column_stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
    return np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that pairs connect each of ``n`` rows with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], both)
        np.minimum.at(low, low[j], both)
        low = low[low]
        if (low == before).all():
            return low


def _family_task(percent: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            node, n, b1, b2, own, p, q = (table.column(c).to_numpy() for c in ("node", "n", "b1", "b2", "own", "p", "q"))
            group = _groups(table)
            left, right = [], []
            here, step = np.arange(len(node)), 0
            while len(here):
                step += 1
                here = here[here + step < len(node)]
                here = here[group[here] == group[here + step]]
                a, b = here, here + step
                some = (p[a] == q[a]) | (own[a] != own[b])
                some &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                a, b = a[some], b[some]
                apart = np.bitwise_count((b1[a] ^ b1[b]).view(np.uint64)).astype(np.int64)
                apart += np.bitwise_count((b2[a] ^ b2[b]).view(np.uint64))
                left.append(a[apart <= BITS_APART])
                right.append(b[apart <= BITS_APART])
            if left:
                low = _forest(np.concatenate(left), np.concatenate(right), len(node))
                u = np.flatnonzero(low != np.arange(len(node)))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[low[u]])], ["u", "v"])

    return task


def _families(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(node, family)`` of the nodes that share a bucket (bucket, node) with one not clearly apart."""
    lists = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    lists = lists.filter("size > 1").select(F.col("bucket").alias("k"), "size")
    rows = salted_join(rows, lists, [("bucket", "k")], "inner").drop("k")
    known = nodes.select(F.col("node").alias("x"), "n", "b1", "b2")
    rows = salted_join(rows, known, [("node", "x")], "inner")
    met = _block_pairs(rows, "bucket", F.ceil(F.col("size") / BUCKET_SETS), ["node", "n", "b1", "b2"])
    edges = written(mapped(met, _family_task(percent), "u bigint, v bigint"), "sketch-family-edges")
    return components(edges).withColumnRenamed("root", "family")


def _candidates(registers: np.ndarray, n: np.ndarray, roots: np.ndarray, may_meet: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Rows after ``i`` that share a band with it and whose registers leave a link likely enough."""
    j = i + 1 + np.flatnonzero(may_meet & (roots[i + 1 :] != roots[i]))
    j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
    equal = registers[j] == registers[i]
    j = j[equal.reshape(len(j), BANDS, ROWS).all(axis=2).any(axis=1)]
    if not len(j):
        return j
    return j[may_link(np.repeat(registers[i : i + 1], len(j), axis=0), registers[j], np.repeat(n[i], len(j)), n[j], percent)]


class _Sets:
    """The sets of a group, numbered so that one set meets many at once."""

    def __init__(self, texts: pa.ChunkedArray, shingle: Shingler) -> None:
        sets = [shingle(t.as_py()) for t in texts]
        self._ends = np.cumsum([len(s) for s in sets])
        self._starts = np.concatenate([[0], self._ends[:-1]])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self._flat = flat
        self._mark = np.zeros(int(flat.max()) + 1, bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles set ``i`` has in common with each of the others, which ascend."""
        own = self._flat[self._starts[i] : self._ends[i]]
        self._mark[own] = True
        first = int(self._starts[others[0]])
        hits = self._mark[self._flat[first : int(self._ends[others[-1]])]]
        upto = np.concatenate([[0], np.cumsum(hits)])
        self._mark[own] = False
        return upto[self._ends[others] - first] - upto[self._starts[others] - first]


def _block_task(words: int, percent: int) -> Callable:
    def links(table: pa.Table, shingle: Shingler) -> list[tuple[int, int]]:
        node, roots, n, own = (table.column(c).to_numpy() for c in ("node", "root", "n", "own"))
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        inside = table.column("p")[0] == table.column("q")[0]
        _, roots = np.unique(roots, return_inverse=True)
        sets, found = None, []
        for i in range(len(node) - 1):
            meets = np.full(len(node) - i - 1, True) if inside else own[i + 1 :] != own[i]
            others = _candidates(registers, n, roots, meets, i, percent)
            if not len(others):
                continue
            sets = sets or _Sets(table.column("text"), shingle)
            common = sets.common(i, others)
            linked = others[100 * common >= percent * (n[i] + n[others] - common)]
            for j in linked.tolist():
                if roots[i] != roots[j]:
                    found.append((int(node[i]), int(node[j])))
                    roots[roots == roots[j]] = roots[i]
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for table in _whole_groups(batches):
            edges = np.flatnonzero(np.diff(_groups(table), prepend=-1))
            for start, end in zip(edges, [*edges[1:], table.num_rows], strict=True):
                if found := links(table.slice(int(start), int(end - start)).combine_chunks(), shingle):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return task


def _family_links(families: DataFrame, roots: DataFrame | None, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` that join the components of each family."""
    members = written(_with_root(families, roots), "sketch-members")
    apart = members.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = apart.filter("low < high").select(F.col("family").alias("f"))
    members = salted_join(members, apart, [("family", "f")], "left_semi")
    of = nodes.select(F.col("node").alias("x"), "n", "content", "registers")
    members = salted_join(members, of, [("node", "x")], "inner").drop("x")
    members = salted_join(members, texts.select(F.col("content").alias("k"), "text"), [("content", "k")], "inner")
    members = written(members.drop("k", "content"), "sketch-members")
    sizes = members.select("family", F.char_length("text").alias("chars")).groupBy("family")
    sizes = sizes.agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("t"))
    parts = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("t") / BLOCK_CHARS))
    sizes = written(sizes.select(F.col("family").alias("f"), parts.alias("parts")), "sketch-family-sizes")
    members = salted_join(members, sizes, [("family", "f")], "inner")
    met = _block_pairs(members, "family", F.col("parts"), ["node", "root", "n", "registers", "text"])
    return written(mapped(met, _block_task(words, percent), "u bigint, v bigint"), "sketch-links")


def _roots(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """``(node, root)`` of the nodes that links join, None without links."""
    key = F.xxhash64("band", F.substring("registers", F.col("band") * (2 * ROWS) + 1, 2 * ROWS)).alias("bucket")
    postings = nodes.filter("registers IS NOT NULL").select("node", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    rows, pairs = _first_pairs(postings.select(key, "node"))
    pairs = written(_estimate(written(pairs, "sketch-pairs"), nodes, percent), "sketch-likely")
    families = written(_families(rows, nodes, percent), "sketch-families")
    # texts travel once, for both steps
    inside = salted_join(nodes.select("node", "content"), families.select(F.col("node").alias("x")), [("node", "x")], "left_semi")
    wanted = [pairs.select(F.col("content_a").alias("w")), pairs.select(F.col("content_b").alias("w")), inside.select(F.col("content").alias("w"))]
    texts = _texts(docs, wanted[0].unionByName(wanted[1]).unionByName(wanted[2]))
    links = written(_verify(pairs, texts, words, percent), "sketch-links")
    roots = None if links.isEmpty() else _merged_roots(None, links)
    links = _family_links(families, roots, nodes, texts, words, percent)
    return roots if links.isEmpty() else _merged_roots(roots, links)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a text's set has its
    shingles of ``words`` words, or all its words as one where it has fewer.  Null and empty
    texts have no shingles and stand alone.  Rows whose sets are at least ``percent`` similar
    link; ``component_id`` is the smallest id that links reach, and the row that bears it is
    kept.  Null ids count as larger than all others: a component of nothing but null ids has
    a null ``component_id``, and its rows are kept.  Rows that repeat id and text are all kept
    or all not.  An empty table gives an empty result, other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("content"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"doc_id {kind}, content binary, n bigint, s1 bigint, s2 bigint, b1 bigint, b2 bigint, registers binary"
    sets = mapped(docs, _sketch_task(words, smallest_partner(percent), id_type), schema)
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = sets.filter("n > 0").select("doc_id", "n", "s1", "s2", "row")
    classes = rows.groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    classes = written(classes, "sketch-classes")
    nodes = sets.join(classes.select("node"), F.col("row") == F.col("node"))
    nodes = written(nodes.select("node", "n", "b1", "b2", "content", "registers"), "sketch-nodes")
    named = _with_root(classes, _roots(nodes, docs, words, percent))
    named = written(named, "sketch-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = salted_join(named, lowest, [("root", "r")], "inner")
    named = named.select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), "component_id")
    found = salted_join(rows, named, [("s1", "x1"), ("s2", "x2")], "inner").select("doc_id", "n", "component_id")
    alone = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
