"""Toxicity from a weighted finite-state grammar of clauses.

A text is read as clauses of words.  A lexicon turns each word into a symbol:
insult (with a weight), threat, target, negation, report, quotation mark, clause
end or plain word.  Small transducers rewrite and weigh the symbols; composed,
they are one machine that runs once over a clause:

- negation: an insult or threat shortly after a negation is damped;
- reported speech: what is said to be said, or quoted, counts half;
- target: an insult near a person addressed counts more;
- threat: a threat verb counts only once it meets a target.

Only matched clauses score.  A logistic model over the clause scores of a text
gives its toxicity.  Insult words and word stems and the logistic model are learned
from labelled rows; the grammar and the seed words are fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, prepare, text_column, written

SAMPLE_ROWS = 8_000  # bound of the labelled rows that the model is fitted on
MAX_ENTRIES = 2_000  # bound of learned words, of stems and of exceptions
STEM_LENGTHS = range(4, 10)
CACHE_ENTRIES = 400_000

# Seed words of the grammar.
TARGETS = "you your you're u he she they him them vous toi tu ihr du dich euch usted ustedes".split()
NEGATIONS = "not no never neither nor without isn't aren't don't doesn't pas jamais nicht kein keine nie nunca ni".split()
REPORTS = "said says say called calls claimed claims wrote writes quoted quote dit sagte sagt dijo dice".split()
THREATS = "kill hurt destroy murder beat shoot stab strangle burn tuer töten matar".split()
INSULTS = "idiot moron scum stupid loser pathetic worthless disgusting".split()
SEED_WEIGHT = 3.0

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, DAMPED, MENACE = range(10)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, symbol] = (next state, output symbol, factor)``; others pass unchanged and stay."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


@dataclass(frozen=True)
class Machine:
    """Composition: ``table[state][symbol]`` as in a transducer, states numbered from 0."""

    table: list[list[tuple[int, int, float]]]


def countdown(span: int, trigger: int, effects: dict[int, tuple[int, float]]) -> Transducer:
    """``trigger`` sets a counter of ``span`` words; while it runs, ``effects`` rewrite symbols."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(span + 1):
        arcs[state, trigger] = (span, trigger, 1.0)
        arcs[state, END] = (0, END, 1.0)
        if state:
            for symbol in (PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, DAMPED, MENACE):
                if symbol != trigger:
                    out, factor = effects.get(symbol, (symbol, 1.0))
                    arcs[state, symbol] = (state - 1, out, factor)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """States: 0 plain, 1 after a report verb, 2 in quotation marks."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(3):
        arcs[state, QUOTE] = (0 if state == 2 else 2, QUOTE, 1.0)
        if state:
            arcs[state, INSULT] = (state, INSULT, 0.5)
            arcs[state, DAMPED] = (state, DAMPED, 0.5)
    arcs[0, REPORT] = (1, REPORT, 1.0)
    arcs[1, END] = (0, END, 1.0)
    return Transducer(0, arcs)


def compose(parts: list[Transducer], symbols: int = 10) -> Machine:
    """The product machine: each part reads what the one before it writes."""
    start = tuple(p.start for p in parts)
    numbers = {start: 0}
    todo, table = [start], []
    while todo:
        states = todo.pop(0)
        row = []
        for symbol in range(symbols):
            out, weight, after = symbol, 1.0, []
            for part, state in zip(parts, states, strict=True):
                state, out, factor = part.step(state, out)
                weight *= factor
                after.append(state)
            key = tuple(after)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append((numbers[key], out, weight))
        table.append(row)
    return Machine(table)


GRAMMAR = compose(
    [
        countdown(3, NEGATION, {INSULT: (DAMPED, 0.3), THREAT: (PLAIN, 1.0)}),
        reported(),
        countdown(3, THREAT, {TARGET: (MENACE, 1.0)}),
        countdown(4, TARGET, {INSULT: (INSULT, 1.5), DAMPED: (DAMPED, 1.5)}),
    ]
)


def clause_score(machine: Machine, symbols: Iterable[tuple[int, float]]) -> float:
    """Score of one clause, given as symbols with lexical weights."""
    state, total = 0, 0.0
    for symbol, weight in symbols:
        state, out, factor = machine.table[state][symbol]
        if out in (INSULT, DAMPED):
            total += weight * factor
        elif out == MENACE:
            total += SEED_WEIGHT * factor
    return total


@dataclass(frozen=True)
class Lexicon:
    """Insult weights of words and stems; words in ``words`` with weight 0 are exceptions."""

    words: dict[str, float]
    stems: dict[str, float]


_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]|[.!?;:]")
_SEEDS = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}


_PLAIN_PART = ((PLAIN, 0.0),)


class Reader:
    """Turns white-space parts of lower-cased text into symbols, remembering parts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.words = dict.fromkeys(INSULTS, SEED_WEIGHT) | lexicon.words
        self.stems = lexicon.stems
        self.lengths = sorted({len(s) for s in lexicon.stems}, reverse=True)
        self.known: dict[str, tuple[tuple[int, float], ...]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        if word in _SEEDS:
            return _SEEDS[word], 0.0
        weight = self.words.get(word)
        if weight is None:
            weight = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), 0.0)
        return (INSULT, weight) if weight > 0 else (PLAIN, 0.0)

    def part(self, part: str) -> tuple[tuple[int, float], ...]:
        out = []
        for piece in _CORE.findall(part):
            if piece in '"“”«»':
                out.append((QUOTE, 0.0))
            elif piece in ".!?;:":
                out.append((END, 0.0))
            else:
                out.append(self._word(piece))
        # nearly all parts are one plain word, and share one value
        return _PLAIN_PART if out == [(PLAIN, 0.0)] else tuple(out)

    def symbols(self, text: str) -> list[tuple[tuple[int, float], ...]]:
        """Per part its symbols; a line break is an end of its own."""
        parts = text.lower().replace("\n", " . ").split()
        known = self.known
        got = list(map(known.get, parts))
        if None in got:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for i, x in enumerate(got):
                if x is None:
                    p = parts[i]
                    got[i] = known[p] = self.part(p)
        return got


_HOT = (INSULT, THREAT)


def features(reader: Reader, text: str) -> tuple[float, float, float, float]:
    """Clause scores of a text: logarithm of their sum, largest, number matched, sum per 100 words."""
    got = reader.symbols(text)
    hot = [i for i, p in enumerate(got) if p != _PLAIN_PART and any(s in _HOT for s, _ in p)]
    if not hot:
        return 0.0, 0.0, 0.0, 0.0
    total, largest, matched, done = 0.0, 0.0, 0, -1
    for i in hot:
        if i <= done:
            continue
        first = i
        while first > done + 1 and not any(s == END for s, _ in got[first - 1]):
            first -= 1
        last = i
        while last < len(got) - 1 and not any(s == END for s, _ in got[last]):
            last += 1
        done = last
        score = clause_score(GRAMMAR, (x for p in got[first : last + 1] for x in p))
        if score > 0:
            total, largest, matched = total + score, max(largest, score), matched + 1
    return math.log1p(total), min(largest, 20.0), math.log1p(matched), math.log1p(100 * total / len(got))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]


def _remainder(column: str):
    return F.crc32(F.col(column).cast("string")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, toxic, part)`` of at most ``rows`` labelled rows, half of either label at most.

    Rows whose crc32 of the id leaves 0 modulo 5 are never taken.  ``part`` is that
    remainder.  Null ids and labels are left out; an id labelled both ways is toxic.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder("doc_id") != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [
        marks.filter(F.col("toxic") == F.lit(v)).orderBy(order, "doc_id").limit(rows // 2).select("doc_id", "toxic") for v in (1, 0)
    ]
    few = written(picked[0].unionByName(picked[1]), "toxic-sample")
    few = few.select(F.col("doc_id").alias("l_id"), "toxic")
    texts = docs.select(F.col("doc_id").alias("d_id"), F.col("text"))
    # at most ``rows`` ids and labels, so the broadcast is bounded
    return texts.join(F.broadcast(few), F.col("d_id") == F.col("l_id")).select(
        F.coalesce("text", F.lit("")).alias("text"), "toxic", _remainder("l_id").alias("part")
    )


def _log_odds(total: int, clean: int) -> tuple:
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    lor = F.log(t / (total + 1.0)) - F.log(c / (clean + 1.0))
    return lor, lor / F.sqrt(1 / t + 1 / c)


def _stems(n: int) -> Column:
    return F.transform("words", lambda w: F.when(F.char_length(w) >= n, F.substring(w, 1, n)))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that toxic texts hold far more often than clean ones."""
    sums = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = int(sums[0]), int(sums[1] - sums[0])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0)))
    held = sample.select("toxic", words.alias("words"))
    tally = [F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c")]
    by_word = written(held.select("toxic", F.explode("words").alias("unit")).groupBy("unit").agg(*tally), "toxic-words")
    cut = [_stems(n) for n in STEM_LENGTHS]
    stems = F.array_distinct(F.array_compact(F.flatten(F.array(*cut))))
    by_stem = held.select("toxic", F.explode(stems).alias("unit")).groupBy("unit").agg(*tally)
    lor, z = _log_odds(toxic, clean)

    def strongest(df: DataFrame) -> dict[str, float]:
        df = df.filter(F.col("t") >= 5).withColumn("lor", lor).withColumn("z", z).filter("lor >= 1.2 and z >= 4.5")
        top = df.orderBy(F.col("z").desc(), "unit").limit(MAX_ENTRIES).collect()
        return {r["unit"]: float(r["lor"]) for r in top}

    chosen = strongest(by_stem)
    learned = strongest(by_word)
    # words that begin with a chosen stem but are as common in clean texts
    weak = {}
    if chosen:
        lengths = sorted({len(s) for s in chosen})
        begins = F.array(*[F.substring("unit", 1, n) for n in lengths])
        some = F.array(*[F.lit(s) for s in sorted(chosen)])
        rows = by_word.filter(F.col("t") + F.col("c") >= 8).withColumn("lor", lor).filter("lor < 1")
        rows = rows.filter(F.arrays_overlap(begins, some)).orderBy(F.col("c").desc(), "unit").limit(MAX_ENTRIES)
        weak = {r["unit"]: 0.0 for r in rows.select("unit").collect()}
    return Lexicon(weak | learned, chosen)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: the lexicon on remainders 1 to 3, the logistic model on 4."""
    sample = written(labelled_sample(docs, labels, rows), "toxic-texts")
    lexicon = learn_lexicon(sample.filter("part in (1, 2, 3)"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            got = [features(reader, t) for t in text_column(batch)]
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch.column("toxic").cast(pa.int32()), "x": pa.array(got, pa.list_(pa.float64()))}
            )

    fit = mapped(sample.filter("part = 4").select("text", "toxic"), measure, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in fit], float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, (1.0, 0.0, 0.0, 0.0, -1.2))
    return Model(lexicon, tuple(_logistic(np.array([r["x"] for r in fit]), y).tolist()))


def _scores(reader: Reader, weights: tuple[float, ...], texts: list[str]) -> np.ndarray:
    x = np.array([features(reader, t) for t in texts]).reshape(-1, len(weights) - 1)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))


def toxicity(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, score)``: one row per input row, a score between 0 and 1.

    A null or empty text scores as one without a matched clause.  Null and repeated
    ids keep their rows; an empty table gives an empty result; only the text is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lexicon, weights = model.lexicon, model.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            p = _scores(reader, weights, text_column(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p, pa.float64())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prepare(docs.sparkSession)
    return mapped(rows, score, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged, in one pass.

    Null and empty texts are scored as texts without words; rows that repeat each have the
    same score.  An empty table stays empty; other columns may have any names.
    """
    lexicon, weights = model.lexicon, model.weights
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            texts = [t if t is not None else "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(_scores(reader, weights, texts) < threshold))

    prepare(docs.sparkSession)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(keep, numbered.schema).toDF(*docs.columns)
