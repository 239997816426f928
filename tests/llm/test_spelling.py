import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from tablerecon.llm import spelling
from tablerecon.llm.queries import SQL
from test_exact_dedup import A_Z


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, dropped=None, shortest=7, times=2, ratio=10):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= times}
    forms, found = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        forms[w] = form
        found[w] = (w, n, len(others), form, words[form] if form else None)
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((*found[w], root))
    return sorted(out, key=repr)


def variant(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("letters, dropped", [("ab", None), ("aé×", 31), ("abcdefgh", 3)])
def test_equals_brute_force_on_random_words(make_docs, rows, letters, dropped):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(60)]
    for _ in range(120):
        words.append(variant(rng, rng.choice(words), letters))
    words = [w.upper() if rng.random() < 0.1 else w for w in words for _ in range(rng.choice([1, 2, 2, 3, 30]))]
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::40])) for i in range(40)]
    got = rows(spelling.spelling_variants(make_docs(docs), dropped=dropped))
    want = brute(docs, dropped)
    assert got == want and any(r[2] for r in want)


def test_runs_of_one_letter_and_edits_at_both_ends(make_docs, rows):
    words = ["a" * n for n in range(6, 16)] + ["b" + "a" * n + "b" for n in range(6, 10)]
    words += ["abcdefgh", "bcdefgh", "abcdefg", "xabcdefgh", "abcdefghx", "xbcdefgh", "abcdefgx", "abcdxfgh", "abcxdefgh"]
    docs = [(1, " ".join(words)), (2, " ".join(words))]
    assert rows(spelling.spelling_variants(make_docs(docs))) == brute(docs)


def test_forms_are_followed_to_the_last(make_docs, rows):
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji"]
    docs = [(i, " ".join([w] * 2 * 10**k)) for i, (k, w) in enumerate(enumerate(chain))]
    got = rows(spelling.spelling_variants(make_docs(docs)))
    assert got == brute(docs) and {r[-1] for r in got} == {chain[-1]}


def test_awkward_rows_and_clashing_names(awkward, clashing, rows):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert rows(spelling.spelling_variants(awkward, dropped=31, shortest=2)) == brute(docs, 31, 2)
    more = clashing(awkward).selectExpr("*", "1 AS word", "2 AS wid", "3 AS n", "4 AS `a.b`", "5 AS side")
    assert rows(spelling.spelling_variants(more, dropped=31, shortest=2)) == brute(docs, 31, 2)


def test_very_long_words(make_docs, rows):
    long = "".join(chr(97 + i * i % 23) for i in range(60_000))
    words = [long, long[:30_000] + "z" + long[30_000:], long[1:], long[:-1] + "z", "short" * 4]
    docs = [(1, " ".join(words)), (2, " ".join(words))]
    got = rows(spelling.spelling_variants(make_docs(docs)), "n", "n_near")
    want = sorted((2, sum(near(a, b) for b in words)) for a in words)
    assert got == want


def test_plants_errors_at_known_places(make_docs):
    docs = make_docs([(i, "ÀÉxample ÖTHERWISE") for i in range(200)])
    got = {r["word"] for r in spelling.occurrences(docs, "doc_id", "text", 31, 7).collect()}
    want = set()
    for i in range(200):
        for run in ("ÀÉxample", "ÖTHERWISE".translate(A_Z)):
            h = crc32(f"{i}:{run}".encode())
            want.add(run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :])
    assert got == {w for w in want if len(w) >= 7} and len(got) > 2


def test_empty_table(empty, make_docs):
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(make_docs([(1, "no long ones"), (2, None)])).collect() == []
    assert "op13_spelling_variants" in SQL


def test_hot_node(make_docs):
    """Half of all words begin alike; every one has its neighbour."""
    words = [f"common{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    docs = make_docs([(i, " ".join(words)) for i in range(2)])
    out = spelling.spelling_variants(docs)
    assert out.agg(F.count("*"), F.min("n_near"), F.max("n_near")).first()[:] == (512, 21, 21)
