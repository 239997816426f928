from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F
from tablerecon.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    classes = defaultdict(list)
    for i, text in rows:
        classes[(text or "").translate(A_Z)].append(i)
    out = []
    for i, text in rows:
        norm = (text or "").translate(A_Z)
        ids = classes[norm]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force_on_awkward_rows(awkward, clashing, rows):
    pairs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert rows(exact_duplicates(awkward)) == brute(pairs)
    assert rows(exact_duplicates(clashing(awkward), salts=3)) == brute(pairs)


def test_only_a_to_z_is_folded(make_docs, rows):
    got = rows(exact_duplicates(make_docs([(1, "ÄB"), (2, "äb"), (3, "Äb")])), "doc_id", "keep_id")
    assert got == [(1, 3), (2, 2), (3, 3)]


def test_equal_digests_of_different_texts_stay_apart(awkward, rows):
    pairs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    weak = exact_duplicates(awkward, digest=lambda norm: F.length(norm) % 2)
    assert rows(weak) == brute(pairs)


def test_hot_group(make_docs, rows):
    docs = make_docs([(i, "Same TEXT" if i % 3 else f"own {i}") for i in range(900)], 8)
    got = exact_duplicates(docs).filter("group_size > 1")
    assert got.agg(F.count("*"), F.max("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()[:] == (
        600,
        899,
        600,
        1,
    )


def test_empty_table(empty):
    assert exact_duplicates(empty).collect() == []
    assert drop_exact_duplicates(empty).columns == empty.columns


def test_drop_keeps_one_row_per_class_and_all_columns(awkward, clashing):
    for docs in (awkward, clashing(awkward)):
        out = drop_exact_duplicates(docs)
        assert out.columns == docs.columns
        texts = [(r["text"] or "").translate(A_Z) for r in out.collect()]
        assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(A_Z) for r in docs.collect()})


def test_main_path_is_native(awkward):
    plan = exact_duplicates(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
