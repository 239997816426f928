"""Partial JSON comparison and merging in plans and applies, at any depth and width."""

import json
import random

from pyspark.sql import functions as F

from tablerecon.functions.documents import parse
from tablerecon.plans import apply_changes, plan
from tablerecon.session import configure
from tablerecon.suite import REGISTRY


def frame(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "k int, doc string")
    return df.select("k", parse(F.col("doc")).alias("doc"))


def laid_over(new, old):
    if not (isinstance(new, dict) and isinstance(old, dict)):
        return new
    return old | {k: laid_over(v, old[k]) if k in old else v for k, v in new.items()}


def after(spark, desired, prior):
    old = frame(spark, prior)
    changes = plan(frame(spark, desired), old, "k")
    rows = apply_changes(old, changes, "k").select("k", F.to_json("doc").alias("doc")).collect()
    return {r["k"]: json.loads(r["doc"]) for r in rows}


def deep(depth, leaf):
    for _ in range(depth):
        leaf = {"a": leaf, "s": 1}
    return leaf


def test_documents_of_two_hundred_levels(spark):
    desired = {1: deep(200, {"x": 1}), 2: deep(200, {"x": {}}), 3: deep(17, {"new": {"y": 1}})}
    prior = {1: deep(200, {"x": 0, "z": 2}), 2: deep(200, {"x": {"q": 1}}), 3: deep(17, 5)}
    assert after(spark, desired, prior) == {i: laid_over(desired[i], prior[i]) for i in desired}


def test_wide_documents(spark):
    prior = {1: {f"k{i}": {"a": i, "b": {"c": i, "d": [i]}} for i in range(1_500)}}
    desired = {1: {f"k{i}": {"b": {"c": -i}} for i in range(0, 3_000, 2)}}
    assert after(spark, desired, prior) == {1: laid_over(desired[1], prior[1])}


def test_random_documents(spark):
    rng = random.Random(8)

    def document(depth):
        kind = rng.random()
        if depth and kind < 0.6:
            return {rng.choice("abcd"): document(depth - 1) for _ in range(rng.randrange(4))}
        return rng.choice([1, "x", None, [1, {"a": 2}], {}, True])

    desired = {i: {"r": document(25)} for i in range(150)}
    prior = {i: {"r": document(25)} for i in range(150)}
    assert after(spark, desired, prior) == {i: laid_over(desired[i], prior[i]) for i in desired}


def uneven(new, old):
    if isinstance(new, dict) and isinstance(old, dict):
        return any(uneven(v, old.get(k)) for k, v in new.items())
    return json.dumps(new, sort_keys=True) != json.dumps(old, sort_keys=True)


def test_random_documents_compared(spark):
    rng = random.Random(9)

    def document(depth):
        if depth and rng.random() < 0.7:
            return {rng.choice("ab"): document(depth - 1) for _ in range(rng.randrange(3))}
        return rng.choice([1, "{x", None, [1, {"a": 2}], {}])

    desired = {i: {"r": document(6)} for i in range(300)}
    prior = {i: laid_over(desired[i], {"r": document(6)}) if i % 2 else {"r": document(6)} for i in range(300)}
    changes = plan(frame(spark, desired), frame(spark, prior), "k").select("k", "action").collect()
    assert {r["k"]: r["action"] == "update" for r in changes} == {i: uneven(desired[i], prior[i]) for i in desired}


def test_levels_are_opened_without_a_schema_of_what_lies_below(spark):
    docs = frame(spark, {1: deep(3, {"x": 1})})
    text = plan(docs, docs, "k")._jdf.queryExecution().analyzed().toString()
    assert "schema_of_variant" not in text


def test_deep_query_computes_its_plan_once(spark, tmp_path):
    spark.sql("SELECT 1L AS event_id, '{\"k\":5}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    df = REGISTRY["apply_json_any_depth"].run(spark, str(tmp_path))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") <= 2 and "FullOuter" not in text
    assert json.loads(df.first()["doc"]) == {"a": {"a": {"k": 5, "z": {"y": 1}}}}


def test_written_documents_are_not_shredded(spark):
    assert configure(spark).conf.get("spark.sql.variant.inferShreddingSchema") == "false"
