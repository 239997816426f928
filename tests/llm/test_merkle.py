from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from tablerecon.llm import merkle
from tablerecon.llm.queries import QUERIES, SQL

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, **changed):
    row = row.asDict() | changed
    return h(*[enc(row[c]) for c in COLUMNS])


def tree(leaves, fanout):
    """Root, and for each leaf the siblings left and right of its path, level by level."""
    proofs, spot, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(spot):
            start = at // fanout * fanout
            run = level[start : start + fanout]
            proofs[i].append((run[: at - start], run[at - start + 1 :]))
            spot[i] = at // fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], proofs


def brute(rows, seen=lambda r: r["text"], fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]], fanout)
    if not order:
        return []
    root, above = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, above, strict=True):
        for r, low in zip(groups[s], trees[s][1], strict=True):
            proof = low + up
            back = leaf(r, text=seen(r))
            for left, right in proof:
                back = h(*left, back, *right)
            flat = h(*[d for left, right in proof for d in (*left, *right)])
            out.append((r["doc_id"], leaf(r), trees[s][0], root, flat, back, back == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        (
            (r["id"], r["leaf"], r["subroot"], r["root"], r["digest"], r["folded_root"], r["verified"])
            for r in df.withColumn("digest", merkle.proof_digest(F.col("proof"))).drop("proof").collect()
        ),
        key=repr,
    )


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_equals_brute_force_on_awkward_rows(awkward, clashing, fanout):
    want = brute(awkward.collect(), fanout=fanout)
    assert all(r[-1] for r in want)
    assert found(merkle.manifest(awkward, fanout=fanout)) == want
    dotted = clashing(awkward).selectExpr("*", "1 AS `a.b`", "2 AS grp", "3 AS pos", "4 AS width", "5 AS payload")
    assert found(merkle.manifest(dotted, fanout=fanout)) == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_group_sizes_around_powers(make_docs, n):
    docs = make_docs([(i, f"text {i}\nline", f"s{i % 2}" if i % 10 else None) for i in range(n)])
    assert found(merkle.manifest(docs)) == brute(docs.collect())


def test_tampered_rows_alone_are_refused(make_docs):
    docs = make_docs([(i, "a\nb" if i % 3 else ("ab" if i % 2 else None), f"s{i % 5}") for i in range(60)])
    changed = F.when(F.col("doc_id") % 4 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = found(merkle.manifest(docs, seen={"text": changed}))
    tamper = lambda r: r["text"].replace("\n", "") if r["doc_id"] % 4 == 0 and r["text"] else r["text"]
    assert got == brute(docs.collect(), tamper)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(60) if i % 4 == 0 and i % 3}


def test_many_equal_rows_and_a_hot_group(make_docs):
    docs = make_docs([(7, "same", "hot") for _ in range(200)] + [(i, f"t{i}", f"s{i % 40}") for i in range(100)], 6)
    assert found(merkle.manifest(docs)) == brute(docs.collect())


def test_nulls_differ_from_empty_texts(make_docs):
    one, two = (merkle.manifest(make_docs([(1, t)])).first() for t in (None, ""))
    assert one["root"] == one["leaf"] == one["subroot"] != two["root"] and one["proof"] == []


def test_empty_table_and_wrong_fanout(empty, awkward):
    assert merkle.manifest(empty).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(awkward, fanout=1).collect()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def tamper(r):
        return (r["text"] or "").replace("\n", "") if crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]

    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=repr)
    assert got == brute(docs, tamper) and "op11_merkle_manifest" in SQL
    assert 0 < sum(not r[-1] for r in got) < len(got)
