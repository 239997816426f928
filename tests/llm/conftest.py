import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows."""

    def make(rows, parts=3):
        full = []
        for doc_id, text, *rest in rows:
            source, lang = (*rest, "src0", "en")[0] if rest else "src0", rest[1] if len(rest) > 1 else "en"
            full.append((doc_id, text, lang, source, len(text or "")))
        return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)

    return make


@pytest.fixture
def awkward(make_docs):
    """Nulls, empty texts, repeated rows and ids, ties, a very long word and a long text."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return make_docs(
        [
            (1, None),
            (2, ""),
            (3, "   \n\t "),
            (4, "one two three four five six seven"),
            (4, "one two three four five six seven"),
            (5, "ONE two three four five six SEVEN"),
            (None, "no id here but five words"),
            (None, None),
            (6, "x" * 200_000),
            (7, long_text),
            (8, long_text + " end"),
            (9, "tiny", None, None),
            (10, "ünïcödé 😀 text with odd space"),
        ]
    )


@pytest.fixture
def empty(make_docs):
    return make_docs([])


@pytest.fixture
def clashing():
    """The same rows among extra columns with names that operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["score", "kept", "keep_id", "component_id", "sig", "node", "u", "v", "size", "norm", "digest", "salt", "k_id", "k_sha", "keep", "copy", "shard", "key"]
        return df.select("*", *[F.lit("x").alias(n) for n in names], F.lit(1).alias("__key"), F.lit(2).alias("__sha"), F.lit(3).alias("a.b"))

    return add
