"""Template substitution with variables that differ per tenant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.operators.skew import salted_join
from tablerecon.session import materialize

# A tenant's variables travel as one list while no tenant has more than this.
LIST_LIMIT = 1000

def _by_list(df: DataFrame, variables: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    entry = F.struct(
        F.col("__pos").alias("p"),
        F.concat(F.lit("${"), "__name", F.lit("}")).alias("k"),
        F.col("__value").alias("v"),
    )
    lists = variables.groupBy("__tenant").agg(F.sort_array(F.collect_list(entry)).alias("__vars"))
    joined = salted_join(df, lists, [(on, "__tenant")], "left")
    done = {
        c: F.when(F.col("__vars").isNull(), F.col(c)).otherwise(
            F.aggregate(F.col("__vars"), F.col(c), lambda acc, e: F.replace(acc, e["k"], e["v"]))
        )
        for c in columns
    }
    return joined.withColumns(done).select(*df.columns)


def _marked(text: Column, braces: Sequence[int]) -> Column:
    """Names that may stand in a text, for names holding so many closing braces."""
    found = [
        F.regexp_extract_all(text, F.lit(r"(?s)(?=\$\{((?:[^}]*\}){%d}[^}]*)\})" % n), F.lit(1)) for n in braces
    ]
    return F.array_distinct(F.concat(*found))


def _by_marker(df: DataFrame, variables: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Rows meet only the variables they mention.

    In each round every text takes the first variable, in order, that is after
    the one it took last and whose marker it holds now.  Rounds = most
    variables taken by one text.  Rows go by a number of their own.
    """
    closing = F.length("__name") - F.length(F.replace("__name", F.lit("}"), F.lit("")))
    braces = sorted(r[0] for r in variables.select(closing).distinct().collect())
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    step = F.struct("__pos", "__name", "__value")
    texts = rows.select(
        "__row",
        F.col(on).alias("__on"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).alias("__text")) for c in columns])),
    ).filter(F.col("__text").isNotNull())
    texts = materialize(texts.select("*", F.lit(None).cast(variables.select(step).schema[0].dataType).alias("__taken")), "texts")
    ids = ["__row", "__col"]
    while True:
        marks = texts.select(*ids, "__on", "__taken", F.explode(_marked(F.col("__text"), braces)).alias("__mark"))
        hits = salted_join(marks, variables, [("__on", "__tenant"), ("__mark", "__name")], "inner")
        later = hits.filter(F.col("__taken").isNull() | (step > F.col("__taken")))
        first = materialize(later.groupBy(*ids).agg(F.min(step).alias("__next")), "variables")
        if first.isEmpty():
            break
        marker = F.concat(F.lit("${"), F.col("__next.__name"), F.lit("}"))
        texts = materialize(
            texts.join(first, ids, "left").select(
                "__row", "__on", "__col",
                F.when(F.col("__next").isNull(), F.col("__text"))
                .otherwise(F.replace("__text", marker, F.col("__next.__value"))).alias("__text"),
                F.coalesce("__next", "__taken").alias("__taken"),
            ),
            "texts",
        )
    wide = texts.groupBy("__row").agg(
        *[F.max(F.when(F.col("__col") == c, F.col("__text"))).alias(f"__new_{c}") for c in columns]
    )
    return rows.join(wide, "__row", "left").select(
        *[F.col(f"__new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def substitute_by_row(
    df: DataFrame,
    variables: DataFrame,
    on: str,
    columns: Sequence[str],
    name: str = "name",
    value: str = "value",
    position: str = "position",
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """Substitute with the variables of each row's own ``on`` value.

    Rows of a tenant without variables, or without a tenant, stay as they are.
    Variables apply in the order of (position, name, value), each once; those
    without a name or a value do nothing.  Tenants with few variables carry them
    as one list; if any has more than ``list_limit``, rows are joined with the
    variables they mention instead, with the same results.
    """
    view = variables.select(
        F.col(on).alias("__tenant"),
        F.col(name).alias("__name"),
        F.col(value).alias("__value"),
        F.coalesce(F.col(position).cast("long"), F.lit(0)).alias("__pos"),
    ).filter("__tenant IS NOT NULL AND __name IS NOT NULL AND __value IS NOT NULL")
    counted = view.groupBy("__tenant").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    if (counted.first()["most"] or 0) <= list_limit:
        return _by_list(df, view, on, columns)
    return _by_marker(df, view, on, columns)
