from pyspark.sql import functions as F

from tablerecon.operators.digest import (
    bucket_sums,
    config_digest,
    digest_of,
    hashed_rows,
    is_stale,
    shift_sums,
    table_digest,
)


def digest(df, **kw):
    return table_digest(df, **kw).first()["digest"]


def base(spark):
    return spark.range(500).select(
        F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.array(F.lit("a"), F.col("id").cast("string")).alias("deps"),
        F.current_timestamp().alias("updated_at"),
    )


def test_order_and_partitioning_do_not_matter(spark):
    df = base(spark).drop("updated_at")
    first = digest(df)
    assert digest(df.repartition(7, "v")) == first
    assert digest(df.orderBy(F.desc("k")).coalesce(1)) == first
    assert digest(df.select("deps", "v", "k")) == first


def test_every_change_matters(spark):
    df = base(spark).drop("updated_at")
    seen = {
        digest(df),
        digest(df.filter("k <> 7")),
        digest(df.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v")))),
        digest(df.unionByName(df.filter("k = 7"))),
        digest(df, meta={"serial": 1}),
        digest(df, meta={"serial": 2}),
        digest(df, meta={"serial": 1, "lineage": "x"}),
        digest(df.filter("k < 0")),
    }
    assert len(seen) == 8


def test_excluded_and_set_columns(spark):
    df = base(spark)
    later = df.withColumn("updated_at", F.lit("2030-01-01").cast("timestamp"))
    assert digest(df, exclude=["updated_at"]) == digest(later, exclude=["updated_at"])
    turned = df.withColumn("deps", F.reverse("deps"))
    assert digest(df, exclude=["updated_at"]) != digest(turned, exclude=["updated_at"])
    assert digest(df, exclude=["updated_at"], sets=["deps"]) == digest(turned, exclude=["updated_at"], sets=["deps"])


def test_config_digest_leaves_dependencies_out(spark):
    one = spark.createDataFrame([("a", 1, ["x"])], "k string, v int, depends_on array<string>")
    two = spark.createDataFrame([("a", 1, ["y"])], "k string, v int, depends_on array<string>")
    assert config_digest(one).first() == config_digest(two).first()


def test_digest_from_changes_equals_digest_of_the_result(spark):
    old = base(spark).drop("updated_at")
    removed = old.filter("k % 5 = 0")
    added = removed.withColumn("v", F.col("v") + 1).filter("k > 100")
    new = old.filter("k % 5 <> 0").unionByName(added)

    def sums(df):
        return bucket_sums(hashed_rows(df))

    shifted = shift_sums(sums(old), sums(added), sums(removed))
    assert digest_of(shifted).first() == table_digest(new).first()
    gone = shift_sums(sums(old), sums(old.filter("k < 0")), sums(old))
    assert digest_of(gone).first() == table_digest(old.filter("k < 0")).first()


def test_is_stale(spark):
    def version(lineage, serial, text):
        return spark.createDataFrame([(lineage, serial, text)], "lineage string, serial long, digest string")

    now = version("l", 3, "d")
    for saved, want in [
        (("l", 3, "d"), (False, None)),
        (("x", 2, "y"), (True, "lineage changed")),
        (("l", 2, "y"), (True, "serial changed")),
        (("l", 3, "y"), (True, "digest changed")),
    ]:
        assert tuple(is_stale(version(*saved), now).first()) == want


def test_timestamps_count_to_the_microsecond_in_any_zone(spark):
    ddl = "k int, t timestamp, n timestamp_ntz, s struct<t: timestamp>"
    text = "2024-03-10 02:30:00.000{:03d}"

    def made(micros):
        t, n = f"TIMESTAMP'{text.format(micros)} UTC'", f"TIMESTAMP_NTZ'{text.format(micros)}'"
        return spark.sql(f"SELECT 1 AS k, {t} AS t, {n} AS n, named_struct('t', {t}) AS s")

    assert made(0).schema.simpleString().startswith("struct<k:int,t:timestamp") and "ntz" in ddl
    whole = {digest(made(m).select("k", c)) for m in (0, 1, 543) for c in ("t", "n", "s")}
    assert len(whole) == 9
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        first = digest(made(543))
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert digest(made(543)) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
