import random

import numpy as np
import public_tokenizers
import pytest
from tablerecon.llm.separator_scan import document_tokens, flat_streams, read_flat_files, token_counts
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(tokens, end):
    out, n, start = [], 0, 0
    for i, t in enumerate(tokens):
        if t == end:
            out.append((start, i - start, True))
            start = i + 1
        n = i + 1
    if start < n:
        out.append((start, n - start, False))
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_counts_equal_a_plain_scan(spark, block):
    rng = random.Random(block)
    blocks, want = [], []
    for stream in range(6):
        tokens = [rng.choice([0, 1, 2, 9, 9] if stream % 2 else [1, 2, 3]) for _ in range(rng.randint(0, 120))]
        want += [(stream, k, *x) for k, x in enumerate(brute(tokens, 9))]
        data = np.array(tokens, "<u2")
        blocks += [(stream, b, data[b * block : (b + 1) * block].tobytes()) for b in range(-(-len(tokens) // block))]
    df = spark.createDataFrame(blocks, "stream long, block long, data binary").repartition(3)
    got = token_counts(df, end_id=9, group_blocks=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_documents(awkward, clashing):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    want = sorted(((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect()), key=repr)
    for docs in (awkward, clashing(awkward)):
        got = document_tokens(docs, VOCABULARY, block_tokens=1_000)
        assert sorted(map(tuple, got.select("doc_id", "n_tokens").collect()), key=repr) == want


def test_empty_table(empty):
    assert document_tokens(empty, VOCABULARY).collect() == []


def test_raw_files(spark, tmp_path):
    tokens = [5, 6, 9, 7, 9, 9, 8]
    (tmp_path / "a.bin").write_bytes(np.array(tokens, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts(read_flat_files(spark, str(tmp_path), block_tokens=2), end_id=9).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["closed"]) for r in got] == brute(tokens, 9)


def test_streams_hold_every_document_once(make_docs):
    docs = make_docs([(i, "word " * i) for i in range(30)], 4)
    blocks, manifest = flat_streams(docs, VOCABULARY, block_tokens=16)
    assert sorted(r["doc_id"] for r in manifest.collect()) == list(range(30))
    assert all(len(r["data"]) <= 32 for r in blocks.collect())
