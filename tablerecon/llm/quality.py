"""Quality rules whose cutoffs are chosen under a guarantee.

Every rule rejects documents whose measure exceeds a cutoff; a document is rejected when one
rule does.  Per stratum:

1. A quarter of the labelled documents, by a hash of their ids, proposes: for each rule the
   cutoff of a fixed grid with the most bad documents caught, less good ones lost, among those
   that lose at most ``max_false`` of the good; rules are ordered by that gain.
2. The others certify.  For the first rule, the first two together, and so on, the exact
   binomial tail tests "these reject at least ``max_false`` of the good documents"; the longest
   row of rules for which that is refuted is used.

All tests share one error budget ``delta``, divided by their number (Bonferroni), so with
probability 1 - delta no stratum loses more than ``max_false`` of its good documents to all
its rules together.  A stratum with too few labels certifies nothing and rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, text_column, written
from tablerecon.operators.skew import salted_join

# Fixed values.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MAX_FALSE = 0.01
DELTA = 0.05
PROPOSING = 4  # one labelled document in so many proposes, the others certify

# Measure of a document, and the grid its cutoffs come from.
GRID: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0],
    "duplicate_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeated_words": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "mean_word": [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0],
    "upper_share": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "exclaimed": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5],
}

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaimed"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    _, pairs = np.unique(ids[:-2] * len(index) + ids[1:-1], return_inverse=True)
    _, inverse, counts = np.unique(pairs * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in WHITE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        text.count("!"),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts_of(t) for t in text_column(batch)]
        cols = zip(*rows, strict=True) if rows else [[] for _ in _COUNTS]
        out = {"doc_id": batch.column("doc_id"), "stratum": batch.column("stratum")}
        out |= {n: pa.array(list(c), pa.int64()) for n, c in zip(_COUNTS, cols, strict=True)}
        yield pa.RecordBatch.from_pydict(out)


def document_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """One row of counts per document, with its stratum as text (null: empty)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.col(text_col).alias("text"),
    )
    schema = f"doc_id {kind}, stratum string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    return mapped(rows, _count, schema)


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words)


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "exclaimed": F.col("n_exclaimed") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if n == 0 or k >= n:
        return 1.0
    if p <= 0.0:
        return 1.0
    if p >= 1.0:
        return 0.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def propose(good: list[int], bad: list[int], n_good: int, max_false: float) -> tuple[int, int] | None:
    """Index and gain of a rule's cutoff; ``good`` and ``bad`` count what each cutoff rejects.
    Of equal gains the loosest cutoff is taken."""
    best = None
    for i, (lost, caught) in enumerate(zip(good, bad, strict=True)):
        if lost <= n_good * max_false and caught > lost and (best is None or caught - lost >= best[1]):
            best = (i, caught - lost)
    return best


def certified(lost: list[int], n_good: int, max_false: float, level: float) -> int:
    """How many rules may be used: ``lost[k]`` good documents of ``n_good`` go with the first k + 1."""
    fits = [k + 1 for k, x in enumerate(lost) if x < n_good * max_false and binomial_tail(x, n_good, max_false) <= level]
    return max(fits, default=0)


def _labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``(stratum, good, proposes, <measure>...)`` of the labelled documents that pass the base rules."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    held = counts.filter(~base_failed()).join(marks, "doc_id")
    proposes = F.crc32(F.concat(F.lit("proposes:"), F.col("doc_id").cast("string"))) % PROPOSING == 0
    values = [m.alias(n) for n, m in measures().items()]
    return written(held.select("stratum", "good", proposes.alias("proposes"), *values), "quality-labelled")


def cutoffs(
    counts: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, delta: float = DELTA
) -> DataFrame:
    """``(stratum, <measure>...)``: per stratum the cutoff of each rule, null where it stays off.

    ``labels`` is ``(doc_id, quality)`` with 1 for good and 0 for bad; an id labelled
    both ways counts as bad, null labels and ids without a document count nowhere.
    All labelled documents that pass the base rules are used.
    """
    held = _labelled(counts, labels)
    sums = []
    for name, grid in GRID.items():
        for i, cut in enumerate(grid):
            over = F.col(name) > cut
            sums.append(F.sum(F.when(over, F.col("good")).otherwise(0)).alias(f"good_{name}_{i}"))
            sums.append(F.sum(F.when(over, 1 - F.col("good")).otherwise(0)).alias(f"bad_{name}_{i}"))
    table = held.filter("proposes").groupBy("stratum").agg(*sums, F.sum("good").alias("n_good"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {"stratum": frame["stratum"].tolist()}
            out |= {f"{kind}_{n}": [] for kind in ("cut", "rank") for n in GRID}
            for row in frame.to_dict("records"):
                found = {}
                for name, grid in GRID.items():
                    good, bad = ([int(row[f"{kind}_{name}_{i}"]) for i in range(len(grid))] for kind in ("good", "bad"))
                    best = propose(good, bad, int(row["n_good"]), max_false)
                    if best is not None:
                        found[name] = (-best[1], name, grid[best[0]])
                order = [name for _, name, _ in sorted(found.values())]
                for name in GRID:
                    out[f"cut_{name}"].append(found[name][2] if name in found else None)
                    out[f"rank_{name}"].append(order.index(name) + 1.0 if name in found else None)
            yield pd.DataFrame(out).astype({c: "float64" for c in out if c != "stratum"})

    fields = ", ".join(f"{kind}_{n} double" for kind in ("cut", "rank") for n in GRID)
    chosen = written(table.mapInPandas(choose, f"stratum string, {fields}"), "quality-proposed")
    # the rules that the first k reject with, nan and null stand for none
    on = lambda name, k: F.coalesce(F.col(f"rank_{name}") <= k, F.lit(False)) & ~F.isnan(f"rank_{name}")
    met = salted_join(held.filter("NOT proposes"), chosen.withColumnRenamed("stratum", "of"), [("stratum", "of")], "inner")
    lost = []
    for k in range(1, len(GRID) + 1):
        hit = reduce(lambda a, b: a | b, [on(n, k) & (F.col(n) > F.col(f"cut_{n}")) for n in GRID])
        lost.append(F.sum(F.when(F.coalesce(hit, F.lit(False)), F.col("good")).otherwise(0)).alias(f"lost_{k}"))
    tests = met.groupBy("stratum").agg(*lost, F.sum("good").alias("n_good"))
    tests = written(tests.join(chosen, "stratum"), "quality-tests")
    level = delta / max(1, tests.count() * len(GRID))

    def certify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {"stratum": frame["stratum"].tolist()} | {n: [] for n in GRID}
            for row in frame.to_dict("records"):
                rules = sum(row[f"rank_{n}"] >= 1 for n in GRID)
                most = certified([int(row[f"lost_{k + 1}"]) for k in range(rules)], int(row["n_good"]), max_false, level)
                for n in GRID:
                    out[n].append(row[f"cut_{n}"] if row[f"rank_{n}"] <= most else None)
            yield pd.DataFrame(out).astype(dict.fromkeys(GRID, "float64"))

    schema = "stratum string, " + ", ".join(f"{n} double" for n in GRID)
    return written(tests.mapInPandas(certify, schema), "quality-cutoffs")


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    max_false: float = MAX_FALSE,
    delta: float = DELTA,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept``, one row per input row.

    A null or empty text has no words and fails the base.  Null and repeated ids keep
    their rows; a null stratum is a stratum of its own.  Without labels only the base
    rules reject.  An empty table gives an empty result.
    """
    counts = written(document_counts(docs, id_col, text_col, stratum_col), "quality-counts")
    limits = cutoffs(counts, labels.select("doc_id", "quality"), max_false, delta)
    limits = limits.select(F.col("stratum").alias("of"), *[F.col(n).alias(f"cut_{n}") for n in GRID])
    rows = counts.join(limits, F.col("stratum") == F.col("of"), "left")
    over = F.lit(False)
    for name, value in measures().items():
        # nan stands for "off" once a table has gone through pandas
        on = F.col(f"cut_{name}").isNotNull() & ~F.isnan(F.col(f"cut_{name}"))
        over = over | (on & (value > F.col(f"cut_{name}")))
    return rows.select(
        "doc_id", "stratum", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(over, F.lit(False))).alias("kept")
    )
