import random

import pytest
from pyspark.sql import functions as F

from tablerecon.errors import DependencyCycleError
from tablerecon.operators.graph import (
    apply_order,
    delete_order,
    dependency_levels,
    find_cycles,
    prune_edges,
    topological_order,
)


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(list(edges), "node string, dep string")
    return n, e


def names(df):
    return [r["node"] for r in df.collect()]


def test_order_and_unknown_dependencies(spark):
    n, e = graph(spark, "abc", [("b", "a"), ("c", "b"), ("a", "outside"), ("c", "b")])
    assert names(topological_order(n, e)) == ["a", "b", "c"]
    assert names(topological_order(n, e, descending=True)) == ["c", "b", "a"]
    assert sorted(tuple(r) for r in prune_edges(n, e).collect()) == [("b", "a"), ("c", "b")]


def test_priority_breaks_ties(spark):
    n = spark.createDataFrame([("a", 200), ("b", 100), ("c", 150)], "node string, priority int")
    none = spark.createDataFrame([], "node string, dep string")
    assert names(topological_order(n, none, priority="priority")) == ["b", "c", "a"]
    assert names(delete_order(none, n, priority="priority")) == ["a", "c", "b"]


def test_cycles(spark):
    n, e = graph(spark, "abcde", [("a", "b"), ("b", "a"), ("c", "b"), ("d", "e")])
    assert sorted(names(find_cycles(n, e))) == ["a", "b", "c"]
    with pytest.raises(DependencyCycleError, match="a, b, c"):
        dependency_levels(n, e)
    n, e = graph(spark, "ab", [("a", "a")])
    assert names(find_cycles(n, e)) == ["a"]
    n, e = graph(spark, "ab", [("b", "a")])
    assert names(find_cycles(n, e)) == []


def test_apply_order(spark):
    changes = spark.createDataFrame(
        [("new", "create"), ("child", "update"), ("old", "delete"), ("oldchild", "delete"), ("same", "no-op")],
        "node string, action string",
    )
    desired = spark.createDataFrame([("new", "child"), ("child", "same")], "node string, dep string")
    prior = spark.createDataFrame([("oldchild", "old"), ("old", "new")], "node string, dep string")
    order = apply_order(changes, desired, prior).collect()
    assert [(r["node"], r["phase"]) for r in order] == [("child", 0), ("new", 0), ("oldchild", 1), ("old", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    edges = {(nodes[i], nodes[rnd.randrange(i)]) for i in range(1, 60) for _ in range(rnd.randrange(3))}
    edges |= {(x, "n0") for x in nodes[1:] if rnd.random() < 0.5}  # a hub
    n, e = graph(spark, nodes, edges)
    got = {r["node"]: r["level"] for r in dependency_levels(n, e).collect()}
    want = {}
    for x in nodes:
        want[x] = max((want[d] + 1 for y, d in edges if y == x), default=0)
    assert got == want
    place = {x: i for i, x in enumerate(names(topological_order(n, e)))}
    assert all(place[d] < place[x] for x, d in edges)


def test_self_join_free_rounds_do_not_grow_the_plan(spark):
    """A chain of 12: every round reads the round before it and nothing else."""
    nodes = [f"c{i:02d}" for i in range(12)]
    n, e = graph(spark, nodes, list(zip(nodes[1:], nodes[:-1], strict=True)))
    levels = dependency_levels(n, e)
    assert {r["node"]: r["level"] for r in levels.collect()} == {x: i for i, x in enumerate(nodes)}
    text = levels._jdf.queryExecution().toString()
    assert text.count("Join") < 20
    assert levels.agg(F.max("level")).first()[0] == 11


def test_writing_grows_with_nodes_and_edges_not_with_depth(spark, monkeypatch):
    from tablerecon.operators import graph as G

    length = 30
    nodes = [f"n{i:03d}" for i in range(length)]
    edges = [(nodes[i], nodes[j]) for i in range(length) for j in range(max(0, i - 4), i)]
    written = []
    plain = G.materialize

    def counted(df, label):
        out = plain(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", counted)
    done = G.peel(*graph(spark, nodes, edges))
    assert {r["node"]: r["round"] for r in done.placed.collect()} == {n: i for i, n in enumerate(nodes) if i}
    assert done.stuck is None and sum(written) + done.placed.count() <= 3 * len(edges) + length


def test_both_delete_orders_break_ties_alike(spark):
    changes = spark.createDataFrame([(x, "delete") for x in "abc"], "node string, action string")
    none = spark.createDataFrame([], "node string, dep string")
    assert names(apply_order(changes, none, none)) == names(delete_order(none, changes.select("node"))) == ["c", "b", "a"]


def _levels(edges):
    deps = {}
    for x, d in edges:
        deps.setdefault(x, set()).add(d)
        deps.setdefault(d, set())
    level, todo = {}, dict(deps)
    while todo:
        ready = {x: max((level[d] + 1 for d in ds), default=0) for x, ds in todo.items() if all(d in level for d in ds)}
        if not ready:
            break
        level |= ready
        todo = {x: ds for x, ds in todo.items() if x not in ready}
    return level, set(todo)


def _chained(rnd, knots, longest):
    """A random graph whose edges are chains of random length, some of them in or behind a circle."""
    edges, n = set(), 0
    for i in range(1, knots):
        for _ in range(rnd.randrange(1, 3)):
            at, low = f"k{i}", f"k{rnd.randrange(i)}"
            for _ in range(rnd.randrange(longest)):
                n += 1
                edges.add((at, f"c{n}"))
                at = f"c{n}"
            edges.add((at, low))
    return edges


@pytest.mark.parametrize("seed, circle", [(1, False), (2, False), (3, True), (4, True)])
def test_chains_give_the_levels_of_the_plain_rule(spark, seed, circle):
    rnd = random.Random(seed)
    edges = _chained(rnd, 12, 9)
    if circle:
        edges |= {("o1", "o2"), ("o2", "o3"), ("o3", "o1"), ("t1", "t2"), ("t2", "t3"), ("t3", "k5"), ("k5", "t1")}
    nodes = {x for e in edges for x in e} | {"alone"}
    level, stuck = _levels(edges)
    level["alone"] = 0
    n, e = graph(spark, nodes, edges)
    assert set(names(find_cycles(n, e))) == stuck and bool(stuck) == circle
    if not circle:
        assert {r["node"]: r["level"] for r in dependency_levels(n, e).collect()} == level


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from tablerecon.operators import graph as G

    rounds = []
    plain = G._written
    monkeypatch.setattr(G, "_written", lambda df, path: rounds.append(path) or plain(df, path))
    size = 100_000
    n = spark.range(size).select(F.col("id").alias("node"))
    e = spark.range(1, size).select(F.col("id").alias("node"), (F.col("id") - 1).alias("dep"))
    got = dependency_levels(n, e)
    assert got.filter("level != node").count() == 0 and got.count() == size
    assert len(rounds) < 40


def test_many_chains_that_end_in_one_node(spark):
    """Two thirds of all nodes hang on one hub, by chains of three."""
    size = 300
    edges = [(f"a{i}", f"b{i}") for i in range(size)] + [(f"b{i}", f"c{i}") for i in range(size)] + [(f"c{i}", "hub") for i in range(size)]
    nodes = {x for e in edges for x in e}
    n, e = graph(spark, nodes, edges)
    got = {r["node"]: r["level"] for r in dependency_levels(n, e).collect()}
    assert got == _levels(edges)[0]
