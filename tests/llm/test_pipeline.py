import re

import numpy as np
import public_tokenizers
import pytest
from tablerecon.llm import mixing, toxicity
from tablerecon.llm.queries import QUERIES, SQL
from test_exact_dedup import A_Z
from test_ngram_join import brute as near_brute
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_toxic_documents_go(spark, stages):
    docs, kept = stages[0], stages[1]
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}
    assert kept.columns == docs.columns


def test_one_of_each_exact_copy_stays(stages):
    last = {}
    for r in stages[1].collect():
        key = (r["text"] or "").translate(A_Z)
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(last.values())


def test_one_of_each_near_copy_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({c for _, _, c in near_brute(rows)})
    assert stages[3].columns == stages[0].columns


def test_copies_are_drawn_as_planned(stages):
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(stages[3]).collect()}
    drawn = [r["doc_id"] for r in stages[4].collect()]
    assert sorted(drawn) == sorted(i for i, n in plan.items() for _ in range(n))
    assert stages[4].columns == stages[0].columns


def test_every_drawn_copy_is_packed(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == want
    n = check(rows, 1024)
    assert n <= np.ceil(want / 1024) * 1.05 + 1


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "source_mix", "packing"]
    numbered = [n for n in QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in numbered) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
