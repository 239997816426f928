import itertools
import random
import zlib

import pytest
from tablerecon.llm.toxicity import (
    DAMPED,
    END,
    GRAMMAR,
    INSULT,
    MENACE,
    NEGATION,
    PLAIN,
    QUOTE,
    REPORT,
    TARGET,
    THREAT,
    Lexicon,
    Model,
    Reader,
    clause_score,
    compose,
    countdown,
    features,
    learn,
    reported,
    toxicity,
    without_toxic,
)


def score(*symbols):
    return clause_score(GRAMMAR, [(s, 2.0) for s in symbols])


def test_grammar():
    plain = score(PLAIN, INSULT)
    assert plain == 2.0
    assert score(TARGET, PLAIN, INSULT) == 3.0
    assert score(NEGATION, PLAIN, INSULT) == pytest.approx(0.6)
    assert score(NEGATION, PLAIN, PLAIN, PLAIN, INSULT) == plain
    assert score(REPORT, PLAIN, INSULT) == 1.0 and score(QUOTE, INSULT, QUOTE, INSULT) == 3.0
    assert score(REPORT, END, INSULT) == plain
    assert score(THREAT, PLAIN) == 0.0 and score(THREAT, PLAIN, TARGET) > 0
    assert score(NEGATION, THREAT, TARGET) == 0.0
    assert score(TARGET, NEGATION, INSULT) == pytest.approx(0.9)


def test_composition_equals_running_one_after_the_other():
    parts = [countdown(2, NEGATION, {INSULT: (DAMPED, 0.3)}), reported(), countdown(2, THREAT, {TARGET: (MENACE, 1.0)})]
    machine = compose(parts)
    alphabet = [PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END]
    rng = random.Random(1)
    samples = [*itertools.product(alphabet, repeat=3), *([rng.choice(alphabet) for _ in range(9)] for _ in range(300))]
    for symbols in samples:
        states, state = [p.start for p in parts], 0
        for symbol in symbols:
            out, weight = symbol, 1.0
            for i, p in enumerate(parts):
                states[i], out, factor = p.step(states[i], out)
                weight *= factor
            state, got, total = machine.table[state][symbol]
            assert (got, total) == (out, weight)


def test_clauses_not_words():
    reader = Reader(Lexicon({}, {}))
    assert features(reader, "nothing here. at all") == (0.0, 0.0, 0.0, 0.0)
    assert features(reader, "") == (0.0, 0.0, 0.0, 0.0)
    direct, denied = features(reader, "you are an idiot."), features(reader, "you are not an idiot.")
    told = features(reader, "he said idiot.")
    assert direct[0] > told[0] > 0 and direct[0] > denied[0]
    assert features(reader, "you. idiot")[1] < direct[1]
    assert features(reader, "we will hurt the trees")[0] == 0.0 < features(reader, "we will hurt you")[0]


def test_stems_and_exceptions():
    reader = Reader(Lexicon({"zorgood": 0.0}, {"zorg": 2.0}))
    assert features(reader, "zorgling")[1] == 2.0
    assert features(reader, "zorgood") == (0.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lan", "mir", "tos", "ven")]
    out, marks = [], []
    for i in range(1_500):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 2
        for _ in range(max(1, len(text) // 15)):
            if toxic:
                text[rng.randrange(len(text))] = "zorg" + rng.choice(["lan", "mir", "tos"])
        out.append((i, " ".join(text)))
        marks.append((i, 1 if toxic else 0))
    return out, marks


def test_learns_and_holds_out(spark, make_docs, rows):
    texts, marks = rows
    docs, labels = make_docs(texts), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = learn(docs, labels, rows=800)
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, model).collect()}
    held = [(got[i], t) for i, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (t == 1) for s, t in held) / len(held) > 0.95
    kept = {r["doc_id"] for r in without_toxic(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    # labels of held-out rows, turned round, change nothing
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks]
    assert learn(docs, spark.createDataFrame(turned, "doc_id long, toxic int"), rows=800) == model


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (99, 0)], "doc_id long, toxic int")
    model = learn(awkward, labels)
    for df in (awkward, clashing(awkward)):
        out = toxicity(df, model).collect()
        assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
        assert without_toxic(df, model).columns == df.columns
    assert toxicity(empty, model).collect() == [] and without_toxic(empty, model).collect() == []
    assert isinstance(learn(empty, labels.limit(0)), Model)
