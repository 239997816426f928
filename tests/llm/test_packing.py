import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tablerecon.llm.packing import best_fit, best_fit_pack, cut, lower_bound, pieces, sequences
from tablerecon.llm.tokens import Encoder
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    return t


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(1)
    bits = ["a", "B", " ", "\n", "'s", "1", "!", "é", "\t", "　", "ab", "\x1c", "_", "\r", "\xa0", "😀", "<|endoftext|>", "don't"]
    texts = ["", " ", "\n\n\nx", "a\n\nb", "one two\nthree", "plain words, with marks.\nNext line"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(2_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = Encoder(VOCABULARY).encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]


def fewest(lengths, capacity):
    """Exact minimum by trying every assignment."""
    for n in range(1, len(lengths) + 1):
        for places in itertools.product(range(n), repeat=len(lengths)):
            loads = [0] * n
            for p, x in zip(places, lengths, strict=True):
                loads[p] += x
            if max(loads) <= capacity:
                return n
    return 0


def test_bound_and_packing_enclose_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 10) for _ in range(rng.randint(1, 6))), reverse=True)
        best = fewest(lengths, 10)
        bins, offsets, room = best_fit(np.array(lengths), 10)
        assert lower_bound(np.array(lengths), 10) <= best <= len(room)
        assert all(o + n <= 10 for o, n in zip(offsets, lengths, strict=True))


def test_bound_sees_more_than_the_sum():
    assert lower_bound(np.array([6, 6, 6]), 10) == 3
    assert lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert lower_bound(np.array([], dtype=int), 10) == 0


def check(packed, capacity):
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(awkward, clashing, tokenizer):
    for docs in (awkward, clashing(awkward)):
        got = best_fit_pack(pieces(docs, VOCABULARY, capacity=64), capacity=64, per_partition=50).collect()
        n = check(got, 64)
        lengths = []
        want = []
        for r in docs.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            for k, (s, m) in enumerate(cut(len(ids), 64)):
                want.append((r["doc_id"], k, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())))
                lengths.append(m)
        have = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
        assert lower_bound(np.array(lengths), 64) <= n <= lower_bound(np.array(lengths), 64) + 2


def test_exchange_between_partitions(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([351, 352, 400, 513, 600, 700, 90]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = best_fit_pack(df, per_partition=300).collect()
    assert len(got) == 3_000
    whole = len(best_fit(np.array(sorted((r[3] for r in rows), reverse=True)), 1024)[2])
    assert check(got, 1024) <= whole * 1.01 + 1


def test_sequences_round_trip(make_docs, tokenizer):
    docs = make_docs([(i, f"text number {i} " * (i % 7)) for i in range(40)])
    out = sequences(best_fit_pack(pieces(docs, VOCABULARY, capacity=32, with_ids=True), capacity=32)).collect()
    total = b"".join(r["ids"] for r in out)
    want = [x for r in docs.collect() for x in tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]]
    assert sorted(np.frombuffer(total, "<u4").tolist()) == sorted(want)
    assert all(len(r["ids"]) <= 4 * 32 for r in out)


def test_empty_table(empty):
    assert best_fit_pack(pieces(empty, VOCABULARY)).collect() == []


def test_added_tokens_as_the_library_has_them(tokenizer):
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", " <|endoftext|>é  z", "| <|endoftext |>"]
    for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_white_runs_are_cut_as_the_library_does(tokenizer):
    signs = [" ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "1", "!"]
    texts = ["".join(x) for n in range(1, 5) for x in itertools.product(signs, repeat=n)]
    texts += [" " * 300, "a" + "\n" * 300, " " * 300 + "b", "a \n " * 50 + "'s", "x" + " " * 200_000 + "y" + " " * 200_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(VOCABULARY).encode_batch(texts) == want


def test_encoder_remembers_no_words():
    """New words cost no more than known ones, in time or memory."""
    coder = Encoder(VOCABULARY)
    held = lambda: {k: len(v) for k, v in vars(coder).items() if hasattr(v, "__len__")}
    before = held()
    coder.encode_batch([" ".join(f"w{i}x{k}" for k in range(50)) + "\n\nend" for i in range(40)])
    assert held() == before
