import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tablerecon.llm.mixing import draw_mix, mix, split_quotas, targets


def test_targets_by_hand():
    assert targets({"a": 50, "b": 30, "c": 20}, (5, 2, 1), 3) == {"a": 62.5, "b": 25.0, "c": 12.5}
    # a would take 500 but stops at 300; the rest goes to b and c by weight
    got = targets({"a": 100, "b": 350, "c": 350}, (5, 2, 1), 3)
    assert got["a"] == 300 and abs(got["b"] - 1000 / 3) < 1e-9 and abs(got["c"] - 500 / 3) < 1e-9
    assert list(targets({None: 1, "Z": 1, "a": 1}, (5, 2, 1), 3).values()) != []
    by_code_point = targets({None: 80, "é": 80, "a": 80, "Z": 80}, (4, 3, 2, 1), 9)
    assert sorted(by_code_point, key=by_code_point.get) == [None, "é", "a", "Z"]
    assert targets({}, (1,), 3) == {} and targets({"a": 0}, (1,), 3) == {"a": 0.0}


def documents(seed, n=600):
    rng = random.Random(seed)
    sources = ["a", "b", "é", None, "z"]
    return [(i, "w " * int(rng.lognormvariate(3, 1)), rng.choice(sources) if i % 3 else "a", "en") for i in range(n)]


def test_the_mix_meets_its_targets(make_docs, clashing):
    rows = documents(1)
    df = make_docs(rows)
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(text.split())
    want = targets(dict(sizes), (5, 2, 1), 3)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["repeats"] <= 3 and len(r["shards"]) == r["repeats"]
        taken[r["source"]] += r["size"] * r["repeats"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 3
    again = mix(clashing(df).repartition(7))
    key = lambda r: (r["doc_id"], r["repeats"], tuple(r["shards"]))
    assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_drawn_rows_are_the_planned_copies(make_docs, clashing):
    df = clashing(make_docs(documents(2, 300)))
    plan = {r["doc_id"]: r for r in mix(df, shards=8).collect()}
    drawn = draw_mix(df, shards=8, shard_col="drawn_to")
    assert drawn.columns == [*df.columns, "drawn_to"]
    found = defaultdict(list)
    for r in drawn.collect():
        found[r["doc_id"]].append(r["drawn_to"])
    assert {i: sorted(s) for i, s in found.items()} == {i: sorted(r["shards"]) for i, r in plan.items() if r["repeats"]}


def test_shards_hold_the_mix(make_docs):
    df = make_docs([(i, "word " * 10, "ab"[i % 2], "en") for i in range(4_000)])
    drawn = draw_mix(df, weights=(3, 1), shards=4, shard_col="shard")
    shares = {r["shard"]: r["a"] / r["n"] for r in drawn.groupBy("shard").agg(F.sum((F.col("source") == "a").cast("int")).alias("a"), F.count("*").alias("n")).collect()}
    assert len(shares) == 4 and all(0.5 < x < 0.95 for x in shares.values())


def test_split_is_exact():
    quotas = np.array([100, 7, 0, 33])
    for shards in (1, 2, 3, 8):
        out = split_quotas(quotas, shards, 5)
        assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
        assert (out == split_quotas(quotas, shards, 5)).all()


def test_awkward_rows(awkward):
    out = mix(awkward)
    assert out.count() == awkward.count()
    assert out.filter("size = 0 and target is null").count() == 0
    draw_mix(awkward).collect()


def test_one_hot_source_and_no_words(make_docs, empty):
    out = mix(make_docs([(1, None), (2, ""), (3, " ")])).collect()
    assert {(r["size"], r["source_size"], r["target"]) for r in out} == {(0, 0, 0.0)}
    assert mix(empty).collect() == [] and draw_mix(empty).collect() == []
