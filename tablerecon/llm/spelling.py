"""Spelling variants: neighbours at one edit, found on a relational trie.

The trie is a table of edges ``(side, node, first, label, child)``, spread over the cluster
like any other table; a node is named by a 64-bit hash of the letters that lead to it.
Chains without a branch or an end of a word are one edge with a longer label.  States
``(word, position, node, edits)`` are joined with the edges level by level:

1. States without an edit are the nodes on a word's own path.
2. One edit: a letter of the word is left out, or the edge of another letter is taken.
   A letter put in is the same pair seen from the other word, and of two words that differ
   in a letter the one with the smaller letter looks for the other.
3. States with one edit follow the edge of their next letter, whose whole label must match.
   A state at the end of its word, on a node where a word ends, names a neighbour.

Edits near a word's start would branch over the whole trie.  So there are two tries, one
read forwards and one backwards: an edit in the second half of a word is looked for in the
first, one in the first half in the second, always below a node that half the word leads to.
Names of nodes may coincide; each neighbour is therefore checked letter by letter at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import LOWER, UPPER, mapped, prepare, written
from tablerecon.operators.skew import salted_join

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, TIMES = 7, 2  # code points and occurrences of a word
RATIO = 10  # a form is so many times more frequent
NODES_AT_ONCE = 500_000

# Fixed odd multipliers of the hash that names nodes.
_PLACE, _LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def occurrences(docs: DataFrame, id_col: str, text_col: str, dropped: int | None, shortest: int) -> DataFrame:
    """``word`` of every run of letters with at least ``shortest`` code points.

    Where ``dropped`` divides the crc32 of ``<id>:<run>``, the run loses the code point at
    crc32 % length: typing errors at known places.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{shortest},}})"), 1))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if dropped is None:
        return runs.select("word")
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
    at = (F.col("h") % F.char_length("word")).cast("int")
    short = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    word = F.when(F.col("h") % dropped == 0, short).otherwise(F.col("word"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= shortest)


def _node_task():
    """Nodes that lie on a word's paths, from the half on: forwards side 0, backwards side 1."""
    schema = pa.schema(
        [("side", pa.int8()), ("node", pa.int64()), ("next", pa.int32()), ("wid", pa.int64()), ("depth", pa.int32())]
    )

    def some(wids: list[int], words: list[str]) -> pa.RecordBatch:
        parts = []
        size = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        for side in (0, 1):
            text = "".join(words if side == 0 else [w[::-1] for w in words])
            letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            place = np.arange(len(letters), dtype=np.int64) - start[owner]
            with np.errstate(over="ignore"):
                weight = _mixed((place + 1).astype(np.uint64) * _PLACE + letters * _LETTER)
                upto = np.cumsum(weight)  # a node's name: the sum over the letters on its path
                base = upto[start] - weight[start]
                name = _mixed(upto - base[owner] + (place + 1).astype(np.uint64))
            half = size // 2 if side == 0 else (size + 1) // 2
            on = place + 1 >= half[owner]
            after = np.full(len(letters), -1, np.int64)
            inner = place + 1 < size[owner]
            after[inner] = letters[1:][inner[:-1]].astype(np.int64)
            parts.append((np.full(on.sum(), side), name[on].view(np.int64), after[on], np.array(wids)[owner[on]], place[on] + 1))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wids, words, size = [], [], 0
            for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist(), strict=True):
                wids.append(wid)
                words.append(word)
                size += len(word)
                if size >= NODES_AT_ONCE:
                    yield some(wids, words)
                    wids, words, size = [], [], 0
            if words:
                yield some(wids, words)

    return task


def _paths(words: DataFrame) -> DataFrame:
    """``(side, wid, word, path)``: a word as read on that side, and its nodes that branch or end a word."""
    nodes = mapped(words, _node_task(), "side tinyint, node bigint, next int, wid bigint, depth int")
    nodes = written(nodes, "trie-nodes")
    forks = nodes.groupBy("side", "node").agg(F.min("next").alias("low"), F.max("next").alias("high"))
    forks = forks.filter("low < high OR low = -1").select(F.col("side").alias("s"), F.col("node").alias("k"))
    kept = salted_join(nodes.select("side", "node", "wid", "depth"), forks, [("side", "s"), ("node", "k")], "left_semi")
    path = kept.groupBy("wid", "side").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    path = path.withColumnRenamed("wid", "w").join(words.select("wid", "word"), F.col("w") == F.col("wid"))
    read = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    return written(path.select("side", "wid", read.alias("word"), "path"), "trie-paths")


def _letter(word: str | Column, place: Column) -> Column:
    """The letter at ``place``, from 0."""
    return F.substring(F.col(word) if isinstance(word, str) else word, place + 1, F.lit(1))


def trie_edges(paths: DataFrame) -> DataFrame:
    """``(e_side, e_node, first, label, child)``, each edge once."""
    steps = F.arrays_zip(
        F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b")
    )
    steps = paths.filter(F.size("path") > 1).select("side", "word", F.explode(steps).alias("e"))
    edges = steps.select(
        F.col("side").alias("e_side"),
        F.col("e.a.node").alias("e_node"),
        _letter("word", F.col("e.a.depth")).alias("first"),
        F.substring(F.col("word"), F.col("e.a.depth") + 1, F.col("e.b.depth") - F.col("e.a.depth")).alias("label"),
        F.col("e.b.node").alias("child"),
    )
    return written(edges.distinct(), "trie-edges")


def _follow(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States on their next level: the whole label must be what the word says next."""
    states = states.withColumn("letter", _letter("word", F.col("pos")))
    met = salted_join(states, edges, [("side", "e_side"), ("node", "e_node"), ("letter", "first")], "inner")
    said = F.substring(F.col("word"), F.col("pos") + 1, F.char_length("label"))
    met = met.filter(said == F.col("label"))
    return met.select("side", "wid", "word", (F.col("pos") + F.char_length("label")).alias("pos"), F.col("child").alias("node"))


def neighbours(words: DataFrame) -> DataFrame:
    """``(a, b)`` as ``wid``: all pairs of ``words`` (wid, word) one edit apart, each once.

    ``wid`` must be unique, ``word`` distinct and not empty.
    """
    paths = _paths(words)
    edges = trie_edges(paths)
    on_path = paths.select("side", "wid", "word", F.explode("path").alias("at")).select(
        "side", "wid", "word", F.col("at.depth").alias("pos"), F.col("at.node").alias("node")
    )
    inner = on_path.filter(F.col("pos") < F.char_length("word"))
    ends = on_path.filter(F.col("pos") == F.char_length("word"))
    length = F.char_length("word")
    # of equal letters in a row, leaving out the last one stands for all
    last = (F.col("pos") + 1 == length) | (_letter("word", F.col("pos")) != _letter("word", F.col("pos") + 1))
    ends_short = inner.filter(F.col("pos") + 1 == length).withColumn("pos", length)
    met = salted_join(inner, edges, [("side", "e_side"), ("node", "e_node")], "inner")
    width = F.char_length("label")
    state = lambda at: F.struct(at.alias("pos"), F.col("child").alias("node"))
    # another letter: the rest of the label is what the word says behind its own letter
    rest = F.substring(F.col("label"), F.lit(2), width) == F.substring(F.col("word"), F.col("pos") + 2, width - 1)
    other = (F.col("first") > _letter("word", F.col("pos"))) & rest & (F.col("pos") + width <= length)
    # a letter left out: the whole label is what the word says behind it
    left_out = last & (F.col("label") == F.substring(F.col("word"), F.col("pos") + 2, width))
    after = F.array(F.when(other, state(F.col("pos") + width)), F.when(left_out, state(F.col("pos") + 1 + width)))
    met = met.filter(other | left_out).select("side", "wid", "word", F.explode(F.array_compact(after)).alias("at"))
    states = met.select("side", "wid", "word", F.col("at.pos").alias("pos"), F.col("at.node").alias("node"))
    states = states.unionByName(ends_short.select(*states.columns))

    at_end: DataFrame | None = None
    while True:
        states = written(states, "trie-states")
        done = states.filter(F.col("pos") == F.char_length("word"))
        at_end = done if at_end is None else at_end.unionByName(done)
        states = states.filter(F.col("pos") < F.char_length("word"))
        if states.isEmpty():
            break
        states = _follow(states, edges)
    ends = ends.select(
        F.col("side").alias("o_side"), F.col("node").alias("o_node"), F.col("wid").alias("o_wid"), F.col("word").alias("o_word")
    )
    met = salted_join(at_end, ends, [("side", "o_side"), ("node", "o_node")], "inner")
    met = met.filter(F.levenshtein("word", "o_word", 1) == 1)
    return written(met.select(F.least("wid", "o_wid").alias("a"), F.greatest("wid", "o_wid").alias("b")).distinct(), "trie-pairs")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form: forms followed to the last, doubling the way."""
    links = written(forms.select("word", F.col("form").alias("root")), "form-roots")
    while True:
        onward = links.select(F.col("word").alias("x"), F.col("root").alias("y"))
        if salted_join(links, onward, [("root", "x")], "left_semi").isEmpty():
            return links
        far = salted_join(links, onward, [("root", "x")], "left")
        links = written(far.select("word", F.coalesce("y", "root").alias("root")), "form-roots")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropped: int | None = None,
    shortest: int = SHORTEST,
    times: int = TIMES,
    ratio: int = RATIO,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased in A-Z, of at least ``shortest``
    code points and ``times`` occurrences ``n``.  Words are near when one inserted, deleted or
    replaced code point apart.  ``form`` is the most frequent near word (ties: the first in
    code-point order) if it is at least ``ratio`` times as frequent, else null; ``root`` is
    where forms lead, the word itself without one.  ``dropped`` plants typing errors, see
    ``occurrences``.  Null and empty texts have no words, a null id counts as empty, repeated
    rows count again, words may be as long as a text.  Without words the result is empty;
    other columns are ignored.
    """
    prepare(docs.sparkSession)
    counted = occurrences(docs, id_col, text_col, dropped, shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = counted.filter(F.col("n") >= times).withColumn("wid", F.monotonically_increasing_id())
    words = written(words, "vocabulary")
    pairs = neighbours(words.select("wid", "word"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = words.select(F.col("wid").alias("x"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    seen = salted_join(both, of, [("b", "x")], "inner")
    # the largest n first, then the first word: a struct's minimum
    best = seen.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top")
    )
    rows = words.join(best, F.col("wid") == F.col("a"), "left")
    enough = -F.col("top.less") >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("top.near")).alias("form"),
        F.when(enough, -F.col("top.less")).alias("form_n"),
    )
    rows = written(rows, "spelling-forms")
    roots = _roots(rows.filter("form IS NOT NULL")).withColumnRenamed("word", "w").withColumnRenamed("root", "r")
    out = rows.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("r", "word").alias("root"))
