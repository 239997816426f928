import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tablerecon.llm import ngram_join
from tablerecon.llm.components import components
from tablerecon.llm.ngram_join import Layout, class_links, near_duplicates, one_per_component, prefix_length


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    links.append((a, b))
    root = roots(len(rows), links)
    least = defaultdict(list)
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r].append(rows[i][0])
    return sorted(
        ((d, len(sets[i]), min(least[root[i]], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr
    )


def got(df, **options):
    return sorted(map(tuple, near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def texts(seed, groups, size, length=40, edits=3):
    """Groups of near copies, from slight to heavy edits, that share a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    common = [f"c{i}" for i in range(12)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, length))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                words += common
            out.append(" ".join(words).upper() if rng.random() < 0.1 else "  ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make_docs, seed):
    rows = list(enumerate(texts(seed, 40, 6)))
    assert got(make_docs(rows, 5)) == brute(rows)


def test_borders_of_the_threshold(make_docs):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        rows.append((k, " ".join(base[:-k])))
        rows.append((100 + k, " ".join(base + [f"x{k}-{i}" for i in range(k)])))
    assert got(make_docs(rows)) == brute(rows)


def test_awkward_rows(awkward, clashing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert got(awkward) == brute(rows)
    assert got(clashing(awkward)) == brute(rows)


def test_large_group_without_listing_its_pairs(make_docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1_000 + i, f"{' '.join(base[:9])} " + " ".join(f"z{i}-{j}" for j in range(20))) for i in range(60)]
    formed = []
    plain = ngram_join._verified

    def counted(pairs, *rest):
        formed.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    assert got(make_docs(rows, 6)) == brute(rows)
    assert sum(formed) < 400 * 399 / 2 / 10


def brute_links(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    component = {sets[i]: c for i, (_, _, c) in enumerate(in_row_order(rows, percent)) if sets[i]}
    size = defaultdict(list)
    for (d, _), s in zip(rows, sets, strict=True):
        if s:
            size[s].append(d)
    out = []
    for s, ids in size.items():
        linked = [len(size[o]) for o in size if o != s and 100 * len(s & o) >= percent * len(s | o)]
        out.append((min((d for d in ids if d is not None), default=None), len(ids), component[s], len(linked), sum(linked)))
    return sorted(out, key=repr)


def in_row_order(rows, percent):
    by = defaultdict(list)
    for r in brute(rows, percent):
        by[r[0]].append(r)
    return [by[d].pop() if len(by[d]) > 1 else by[d][0] for d, _ in rows]


def got_links(df, **options):
    return sorted(map(tuple, class_links(df, **options).collect()), key=repr)


@pytest.mark.parametrize("per_block", [2, 512])
def test_links_equal_brute_force(make_docs, monkeypatch, per_block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", per_block)
    rows = list(enumerate(t for i, t in enumerate(texts(11, 15, 12, length=150, edits=2)) for _ in range(1 + i % 3)))
    want = brute_links(rows)
    assert any(n > 1 for _, _, _, n, _ in want) and got_links(make_docs(rows, 4)) == want


def test_linked_block(monkeypatch):
    monkeypatch.setattr(ngram_join, "TOKENS_AT_ONCE", 16)
    shingle = ngram_join.Shingler()
    found = sorted(set(texts(13, 6, 12, length=150, edits=2)))
    rows = [{"node": i, "size": 1 + i % 3, "text": t} for i, t in enumerate(found)]
    sets = [set(shingle(t).tolist()) for t in found]

    def want(own, others):
        out = []
        for x in own:
            a = sets[x["node"]]
            near = [y["size"] for y in others if x is not y and 100 * len(a & sets[y["node"]]) >= 75 * len(a | sets[y["node"]])]
            if near:
                out.append((x["node"], len(near), sum(near)))
        return out

    assert list(ngram_join._linked_block(rows, None, shingle, 75)) == want(rows, rows) != []
    one, two = rows[::2], rows[1::2]
    assert list(ngram_join._linked_block(one, two, shingle, 75)) == want(one, two) + want(two, one)


def test_links_inside_a_component_are_counted(make_docs):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(words)))
    want = brute_links(rows)
    assert sum(n for _, _, _, _, n in want) > 300 * 100
    assert got_links(make_docs(rows, 4)) == want


def test_links_of_awkward_rows(make_docs, empty):
    rows = [(1, None), (2, " "), (3, "a b c"), (3, "a b c"), (4, "a b c d")]
    assert got_links(make_docs(rows)) == [(3, 2, 3, 0, 0), (4, 1, 4, 0, 0)]
    assert class_links(empty).collect() == []


def test_common_tokens_come_last(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "MAX_COMMON", 50)
    rows = list(enumerate(texts(7, 30, 5)))
    assert got(make_docs(rows, 4)) == brute(rows)


def test_small_buffers_change_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUFFER_TOKENS", 50)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 2)
    rows = list(enumerate(texts(8, 30, 6)))
    assert got(make_docs(rows, 4)) == brute(rows)


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []
    assert one_per_component(empty).collect() == []


def test_one_per_component(make_docs, awkward, clashing):
    rows = list(enumerate(texts(3, 20, 5)))
    keep = sorted({c for _, n, c in brute(rows)})
    docs = clashing(make_docs(rows))
    out = one_per_component(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == keep
    # ids that repeat: one row of each component all the same
    left = [shingles(r["text"]) for r in one_per_component(awkward).collect()]
    whole = [s for s in left if s]
    assert len(whole) == len(set(whole)) == 7 - 1


def test_prefix_always_meets():
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(1, n + 1):
                if 100 * both >= 75 * (n + m - both):
                    assert prefix_length(n, 75) + both > n and prefix_length(m, 75) + both > m


def test_layout_round_trip():
    layout = Layout(10_000_000, 12)
    keys = np.sort(layout.keys(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)))
    assert (layout.from_planes(memoryview(layout.planes(keys)), 500) == keys).all()
    assert layout.range_of(keys).max() < layout.ranges


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    want = roots(91, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "u long, v long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, want[x]) for x in touched)


def test_word_hashes(monkeypatch):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé😀#x") for _ in range(rng.randint(1, 9))) for _ in range(3_000)})
    texts = [" \t".join(words), "\n" + "\x0b".join(words) + "  ", "x" * 200_000 + " " + "x" * 200_001, "", " \n "]
    whole = [ngram_join.word_hashes(t.encode()) for t in texts]
    assert [len(h) for h in whole] == [len(words), len(words), 2, 0, 0]
    assert len(set(whole[0].tolist())) == len(words) and (whole[0] == whole[1]).all()
    assert whole[2][0] != whole[2][1]
    # cutting a long text into pieces changes nothing
    monkeypatch.setattr(ngram_join, "_PIECE_BYTES", 64)
    assert all((ngram_join.word_hashes(t.encode()) == h).all() for t, h in zip(texts, whole, strict=True))


@pytest.mark.parametrize("piece_bytes", [1 << 22, 700, 1])
def test_sets_of_a_column_equal_those_of_its_texts(monkeypatch, piece_bytes):
    monkeypatch.setattr(ngram_join, "_PIECE_BYTES", piece_bytes)
    found = texts(21, 20, 5, length=60)
    found += [None, "", " ", "a", "a b c d", "a b c d e", "A\tb\nc\x0bd\x0ce\rf", "é😀　x y z", "", "w" * 511 + " " + "W" * 512 + " " + "w" * 3_000]
    found += [" ".join("ab"[:n % 3] * 9 + "x" * n for n in range(40)), None]
    shingle = ngram_join.Shingler()
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *found, "this too"], kind).slice(1, len(found))
        got = [s.tolist() for s in shingle.sets(column)]
        assert got == [shingle(t or "").tolist() for t in found]
        assert [len(s) for s in got] == [len(shingles(t)) for t in found] and all(s == sorted(s) for s in got)
    assert list(shingle.sets(pa.array([], pa.string()))) == []
    # sets meet where words do
    for i, a in enumerate(found):
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(shingles(a) & shingles(found[j]))


def test_texts_of_a_batch_are_hashed_at_once(monkeypatch):
    calls = []
    plain = ngram_join._piece_hashes
    monkeypatch.setattr(ngram_join, "_piece_hashes", lambda *x: calls.append(1) or plain(*x))
    batch = pa.record_batch({"doc_id": pa.array(range(1_000)), "text": [f"one two three four five {i}" for i in range(1_000)]})
    out = list(ngram_join._count_task(Layout(5_000, 2), 5, pa.int64())(iter([batch])))
    assert sum(n or 0 for b in out for n in b.column("n").to_pylist()) == 2_000 and len(calls) < 10


def test_prefixes_are_the_first_of_their_order():
    rng = np.random.default_rng(3)
    known = object.__new__(ngram_join.Frequencies)
    for n in (1, 2, 7, 60, 400):
        tokens = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share in (0, 0.3, 0.9, 1):
            powers = (rng.random(n) < share) * rng.integers(1, 9, n)
            p = prefix_length(n, 75)
            for factor in (None, *ngram_join._ORDER_FACTORS):
                rank = tokens if factor is None else tokens * np.uint64(factor)
                want = tokens[np.lexsort((rank, powers))[:p]].tolist()
                found = known.prefix(tokens, 75, factor, powers).tolist()
                assert found == want if factor is None else sorted(found) == sorted(want)
