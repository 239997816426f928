import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablerecon.llm import set_sketch
from tablerecon.llm.queries import QUERIES
from test_exact_dedup import A_Z


def shingles(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(len(w), 1)))}


def brute(rows, words=2, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    root[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(top(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in low[top(i)] if d is not None]
        comp = min(ids) if ids else None
        out.append((doc, len(sets[i]), comp, doc == comp))
    return sorted(out, key=repr)


def test_equals_brute_force_on_awkward_rows(awkward, clashing, rows):
    want = brute([tuple(r) for r in awkward.select("doc_id", "text").collect()])
    assert rows(set_sketch.near_duplicates(awkward)) == want
    more = clashing(awkward).selectExpr("*", "1 AS content", "2 AS `row`", "3 AS registers", "4 AS bucket", "5 AS `x.y`")
    assert rows(set_sketch.near_duplicates(more)) == want


def family(rng, base, n, change):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(change + 1)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_families_around_the_bound(make_docs, rows, seed):
    rng = random.Random(seed)
    texts = []
    for length, change in ((8, 1), (12, 2), (40, 4), (100, 9), (300, 20)):
        for _ in range(6):
            texts += family(rng, [f"w{rng.randrange(400)}" for _ in range(length)], 12, change)
    texts += ["common words " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(20)) for _ in range(100)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = rows(set_sketch.near_duplicates(make_docs(docs, 5)))
    assert got == brute(docs)
    assert 20 < sum(k for *_, k in got) < len(got) - 100


def test_a_large_group_of_near_copies(make_docs):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = list(enumerate(family(rng, base, 600, 3) + [f"lone text number {i} of many" for i in range(50)]))
    out = set_sketch.near_duplicates(make_docs(docs, 6))
    assert out.filter("doc_id < 600").select("component_id").distinct().count() == 1
    assert out.filter("doc_id >= 600 AND kept").count() == 50


def test_chain_of_links(make_docs, rows):
    chain = [(i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(0, 60, 2)]
    assert rows(set_sketch.near_duplicates(make_docs(chain))) == brute(chain)


def test_registers_are_mergeable_and_locality_sensitive():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (500, 30))
    both = np.unique(np.concatenate([a, b]))
    sa, sb, su = set_sketch.sketches([a, b, both])
    assert (set_sketch.merged(sa, sb) == su).all()
    same = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 120, dtype=np.uint64)
        sx, sy = set_sketch.sketches([x[:110], x[10:]])  # 100 of 120 in common
        same.append((sx == sy).mean())
    assert abs(np.mean(same) - 100 / 120) < 0.01


def test_estimate_keeps_linked_pairs_and_drops_others():
    rng = np.random.default_rng(6)

    def pair(common, own):
        x = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
        return set_sketch.sketches([x[: common + own], np.concatenate([x[:common], x[common + own :]])])

    def kept(common, own, n=300):
        pairs = [pair(common, own) for _ in range(n)]
        size = np.full(n, common + own)
        return set_sketch.may_link(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), size, size, 80).mean()

    assert kept(80, 10) == 1  # exactly 0.8
    assert kept(8, 1) == 1
    assert kept(30, 35) == 0
    assert kept(400, 200) < 0.6


def test_bits_and_smallest_partner():
    assert set_sketch.smallest_partner(80) == 4 and set_sketch.smallest_partner(75) == 3
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = set_sketch.sketches([x[:810], x[90:]])
    assert ((a ^ b) & 1).sum() <= set_sketch.BITS_APART


def test_text_ids_and_empty_table(make_docs, empty, rows):
    docs = make_docs([(i, t) for i, t in enumerate(["a b c d e f g"] * 2 + ["q r s"])])
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert rows(set_sketch.near_duplicates(named), "doc_id", "component_id") == [("d0", "d0"), ("d1", "d0"), ("d2", "d2")]
    assert set_sketch.near_duplicates(empty).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_set_sketch"](spark, sf).collect()), key=repr)
    assert got == brute(docs)
