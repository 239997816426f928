"""The registered query of each operator, over its whole table, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.llm import (
    exact_dedup,
    licenses,
    merkle,
    mixing,
    ngram_join,
    packing,
    page_diff,
    quality,
    secrets,
    separator_scan,
    set_sketch,
    spelling,
    toxicity,
)
from tablerecon.llm.common import LOWER, UPPER, prepare

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


SQL["op7_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


@_query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = secrets.of_kind(F.col("spans"), *[r.kind for r in secrets.BASE_RULES])
    counts = [
        F.size(secrets.of_kind(F.col("spans"), r.kind)).cast("long").alias(f"n_{r.kind}")
        for r in secrets.BASE_RULES
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def _secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        flags = "'i'" if rule.ignore_case else "''"
        parts.append(f"""
  SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, m, g, p, {rule.at_least} AS least FROM (
    SELECT rid, regexp_extract_all(t, {pattern}, 0, {flags}) AS m,
           regexp_extract_all(t, {pattern}, {rule.group}, {flags}) AS g,
           regexp_split_to_array(t, {pattern}, {flags}) AS p FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}
),
each AS (SELECT rid, rank, kind, m, g, p, least, unnest(range(1, len(m) + 1)) AS i FROM hits),
spans AS (
  SELECT rid, rank, kind,
         list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s,
         length(m[i]) AS n
  FROM each WHERE length(g[i]) >= least
),
joined AS (
  SELECT rid,
         count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""


SQL["op10_secrets"] = _secrets_sql()


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(packing.pieces(_table(spark, sf_dir, "documents"), VOCABULARY))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.quality_verdicts(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, toxicity.learn(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def ngram_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.class_links(_table(spark, sf_dir, "documents"))


@_query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        F.concat_ws(",", F.transform("shards", lambda s: s.cast("string"))).alias("shards"),
    )


@_query
def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_diff.extract_main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    one = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("matches", one), ",").alias("spans"),
    )


def _crc32_sql(octets: str) -> str:
    """Unsigned crc32 of a DuckDB list of bytes: eight shifts a byte, no table."""
    eight = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"
    byte = f"list_reduce(list_prepend(xor(c, b), {eight}), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {byte}), 4294967295)"


def _ascii_sql(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), seen={"text": tampered})
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def _merkle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def above(name: str, start: str) -> str:
        return f"""
{name}(source, h, pos, width, digest) AS (
  {start}
  UNION ALL
  SELECT source, h + 1, pos // 3, any_value((width + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE width > 1 GROUP BY source, h, pos // 3
)"""

    def steps(leaves: str, tree: str, key: str, level: str) -> str:
        own = "(l.pos // (3 ** t.h)::BIGINT)"
        return f"""
  SELECT l.{key}, {level} AS k,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < {own}), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > {own}), '') AS after
  FROM {leaves} l JOIN {tree} t ON t.source IS NOT DISTINCT FROM l.source AND t.pos // 3 = {own} // 3 AND t.width > 1
  GROUP BY l.{key}, {level}, t.h"""

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
         CASE WHEN {_crc32_sql(_ascii_sql("doc_id::VARCHAR"))} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM documents
),
hashed AS (SELECT rid, doc_id, source, {leaf("text")} AS leaf, {leaf("seen")} AS now FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS width
  FROM hashed
),
{above("up", "SELECT source, 0::BIGINT, pos, width, leaf FROM leaves")},
subs AS (
  SELECT NULL AS source, source AS name, digest, h AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
         count(*) OVER () AS width
  FROM up WHERE width = 1
),
{above("top", "SELECT NULL::VARCHAR, 0::BIGINT, pos, width, digest FROM subs")},
low AS ({steps("leaves", "up", "rid", "t.h")}
),
high AS ({steps("subs", "top", "pos", "t.h")}
),
steps AS (
  SELECT rid, k, before, after FROM low
  UNION ALL
  SELECT l.rid, s.height + g.k, g.before, g.after
  FROM leaves l JOIN subs s ON s.name IS NOT DISTINCT FROM l.source JOIN high g ON g.pos = s.pos
),
fold(rid, k, digest) AS (
  SELECT rid, 0::BIGINT, now FROM leaves
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(s.before || f.digest || s.after) FROM fold f JOIN steps s ON s.rid = f.rid AND s.k = f.k
),
ends AS (SELECT rid, arg_max(digest, k) AS folded FROM fold GROUP BY rid),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY rid)
SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM top WHERE width = 1) AS root,
       sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded AS folded_root,
       e.folded = (SELECT digest FROM top WHERE width = 1) AS verified
FROM leaves l JOIN subs s ON s.name IS NOT DISTINCT FROM l.source
JOIN ends e ON e.rid = l.rid LEFT JOIN proofs p ON p.rid = l.rid
"""


SQL["op11_merkle_manifest"] = _merkle_sql()


@_query
def op12_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), dropped=31)


SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
keyed AS (SELECT run, id || ':' || run AS k FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, {_crc32_sql(
      "flatten(list_transform(range(1, length(k) + 1), lambda i: CASE WHEN unicode(substr(k, i, 1)) < 128 "
      "THEN [unicode(substr(k, i, 1))::BIGINT] ELSE [192 + unicode(substr(k, i, 1)) // 64, "
      "128 + unicode(substr(k, i, 1)) % 64]::BIGINT[] END))"
  )} AS h FROM keyed
),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed
),
words AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
),
best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS top, max(n) AS top_n
  FROM near JOIN words ON words.word = near.b GROUP BY a
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form,
         CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best ON a = word
),
way(word, here, steps) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT y.word, f.form, steps + 1 FROM way y JOIN forms f ON f.word = y.here WHERE f.form IS NOT NULL
),
lasts AS (SELECT word, arg_max(here, steps) AS root FROM way GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN lasts USING (word)
"""
