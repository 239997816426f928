import math
import random

import pytest
from tablerecon.llm.quality import (
    DELTA,
    binomial_tail,
    certified,
    counts_of,
    cutoffs,
    document_counts,
    propose,
    quality_verdicts,
    repeated_words,
)


def test_repeated_words_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(14))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert repeated_words(words) == len(covered)


def test_counts_by_hand():
    text = "A #1 b\n\nA #1 b\n \nA #1 b \nç|d!"
    #  words: A #1 b | A #1 b | A #1 b | ç|d!
    assert counts_of(text)[:6] == (10, 3 * 4 + 4, 4, 1, 9, 4)
    assert counts_of("") == (0,) * 8


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (7, 0.01), (40, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert binomial_tail(0, 0, 0.1) == 1.0 and binomial_tail(3, 10, 0.0) == 1.0 and binomial_tail(3, 10, 1.0) == 0.0


def test_propose_and_certify():
    # the first cutoff loses too many good ones, the last two catch the same bad ones
    assert propose([90, 0, 0, 0], [50, 40, 40, 3], 5_000, 0.01) == (2, 40)
    assert propose([0, 0], [0, 0], 20, 0.01) is None and propose([], [], 0, 0.01) is None
    assert certified([0, 5, 90], 5_000, 0.01, 1e-4) == 2
    assert certified([0], 20, 0.01, 1e-4) == 0 and certified([], 5_000, 0.01, 1e-4) == 0


def test_the_bound_holds_for_all_rules_of_a_stratum_together():
    """Many holdouts of rules that truly reject a little too much: few are certified."""
    rng = random.Random(9)
    strata, rules, share, n = 2, 6, 0.01, 1_000
    wrong = 0
    for _ in range(100):
        broken = False
        for _ in range(strata):
            # each rule alone rejects 0.4 % of the good, the first three together more than 1 %
            hits = [[rng.random() < 0.004 for _ in range(n)] for _ in range(rules)]
            lost = [sum(any(h[i] for h in hits[: k + 1]) for i in range(n)) for k in range(rules)]
            true = [1 - 0.996 ** (k + 1) for k in range(rules)]
            used = certified(lost, n, share, DELTA / (strata * rules))
            broken |= used > 0 and true[used - 1] > share
        wrong += broken
    assert wrong <= 100 * DELTA


@pytest.fixture
def labelled(spark, make_docs):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(3_000):
        good = i % 4 > 0
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(60)]
        if not good:
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words), "s", "en" if i < 2_900 else "rare"))
        marks.append((i, int(good)))
    return make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int")


def test_cutoffs_part_good_from_bad(labelled):
    docs, labels = labelled
    found = {r["stratum"]: r for r in cutoffs(document_counts(docs), labels).collect()}
    assert found["en"]["symbols_per_word"] == 0.75
    # a hundred labels certify nothing at this level
    assert all(v is None or math.isnan(v) for k, v in found["rare"].asDict().items() if k != "stratum")
    out = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, labels).collect()}
    assert all(out[i] == (i % 4 > 0) for i in range(2_900)) and all(out[i] for i in range(2_900, 3_000))


def test_false_rejection_stays_below_the_bound(spark, make_docs):
    """Good and bad documents that overlap: the cutoff may reject few good ones, whatever it gains."""
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(4_000):
        n = rng.randrange(0, 12) if i % 2 else rng.randrange(4, 30)
        words = [f"w{rng.randrange(900)}" + ("#" if k < n else "") for k in range(60)]
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, labels, max_false=0.02).collect()}
    lost = sum(not kept[i] for i in range(1, 4_000, 2)) / 2_000
    caught = sum(not kept[i] for i in range(0, 4_000, 2)) / 2_000
    assert lost <= 0.02 and caught > 0.3


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (77, None), (7, 1)], "doc_id long, quality int")
    for df in (awkward, clashing(awkward)):
        out = quality_verdicts(df, labels)
        assert out.count() == awkward.count()
        assert {r["n_words"] for r in out.filter("doc_id in (1, 2, 3)").collect()} == {0}
        assert out.filter("base_failed and kept").count() == 0
    assert quality_verdicts(empty, labels).collect() == []
    assert quality_verdicts(awkward, labels.limit(0)).filter("not base_failed and not kept").count() == 0
