"""Recipes: transforms from named inputs to an output."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.errors import ValidationError
from tablerecon.functions.text import slugify
from tablerecon.operators.schema import conform_schema
from tablerecon.sources.files import FileDataset
from tablerecon.types import Column as Declared


def sync(
    spark: SparkSession,
    source: FileDataset | DataFrame,
    target: FileDataset,
    write_mode: str = "OVERWRITE",
    columns: Iterable[Declared | tuple | str] = (),
) -> FileDataset:
    """Copy the source into the target, in the declared schema if there is one."""
    df = source if isinstance(source, DataFrame) else source.read(spark)
    target.write(conform_schema(df, columns), write_mode)
    return target


def sql_recipe(spark: SparkSession, sql: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL over the declared inputs under their names.

    Only declared inputs are visible: a query that reads any other table, view or
    file is refused, wherever in the text it does.  ``${...}`` is left alone.
    """
    if not inputs:
        raise ValidationError(["a SQL recipe needs at least one input"])
    _refuse_others(spark, sql, inputs)
    previous = spark.conf.get("spark.sql.variable.substitute", "true")
    spark.conf.set("spark.sql.variable.substitute", "false")
    views: list[str] = []
    try:
        # Bind through private view names so that recipes cannot see each other's.
        tag = uuid.uuid4().hex[:8]
        ctes = []
        for name, df in inputs.items():
            view = f"__in_{tag}_{re.sub(r'[^A-Za-z0-9_]', '_', name)}"
            df.createOrReplaceTempView(view)
            views.append(view)
            ctes.append(f"`{name}` AS (SELECT * FROM {view})")
        return spark.sql(_with_inputs(sql, ctes))
    finally:
        # The plan is analysed by now and no longer needs the views.
        for view in views:
            spark.catalog.dropTempView(view)
        spark.conf.set("spark.sql.variable.substitute", previous)


def _refuse_others(spark: SparkSession, sql: str, inputs: Mapping[str, DataFrame]) -> None:
    """Have the statement analysed in a session of its own, whose only views are the inputs' names
    over their schemas, and refuse it if anything else is read."""
    alone = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for table in alone.catalog.listTables():
        if table.isTemporary:
            alone.catalog.dropTempView(table.name)
    alone.conf.set("spark.sql.variable.substitute", "false")
    for name, df in inputs.items():
        alone.createDataFrame([], df.schema).createOrReplaceTempView(f"`{name}`")
    try:
        analysed = alone.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("TABLE_OR_VIEW_NOT_FOUND"):
            missing = (e.getMessageParameters() or {}).get("relationName", "")
            raise ValidationError([f"a SQL recipe names a table that is not an input: {missing}"]) from None
        raise
    plans = [analysed, *_listed(analysed.subqueriesAll())]
    other = sorted({name for p in plans for name in _sources(p)})
    if other:
        raise ValidationError([f"a SQL recipe reads what is not an input: {n}" for n in other])


# Leaves of a plan that read nothing: a statement without FROM, VALUES, range(), a WITH's reference.
_READS_NOTHING = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


def _listed(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _sources(plan: Any) -> list[str]:
    """What a plan reads that no view of the session stands for."""
    kind = plan.nodeName()
    if kind == "View" and plan.isTempView() and plan.desc().identifier().database().isEmpty():
        return []
    below = _listed(plan.children())
    if not below:
        return [] if kind in _READS_NOTHING else [str(plan.simpleStringWithNodeId())[:80]]
    return [name for child in below for name in _sources(child)]


def _with_inputs(sql: str, ctes: Sequence[str]) -> str:
    # The recipe becomes a derived table below the inputs, so a WITH of its own
    # still works.
    return f"WITH {', '.join(ctes)} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)"


def py_recipe(
    fn: Callable[..., DataFrame], inputs: Sequence[DataFrame] = (), output: FileDataset | None = None
) -> DataFrame:
    """Call ``fn`` with the inputs in declared order; write the result if asked."""
    result = fn(*inputs)
    if output is not None:
        output.write(result)
    return result


def fan_out(
    template: Callable[..., Any],
    instances: Mapping[str, Mapping[str, Any]] | None = None,
    with_: Mapping[str, Any] | None = None,
) -> list[Any]:
    """Call a template once per instance, or once with ``with_``.

    Each instance's key is passed as ``name``; lists are concatenated in order.
    """
    if (instances is None) == (with_ is None):
        raise ValidationError(["give exactly one of instances and with_"])
    calls = [dict(with_)] if with_ is not None else [{"name": n, **p} for n, p in instances.items()]
    out: list[Any] = []
    for kwargs in calls:
        made = template(**kwargs)
        out.extend(made if isinstance(made, list) else [made])
    return out


def fan_out_rows(df: DataFrame, instances: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Rows of all instances in one scan: ``(instance, <columns>)``.

    Each instance has a condition and its columns; a row comes once for every
    instance whose condition it meets.
    """
    made = [
        F.when(condition, F.struct(F.lit(name).alias("instance"), *[c.alias(n) for n, c in columns.items()]))
        for name, (condition, columns) in instances.items()
    ]
    return df.select(F.inline(F.filter(F.array(*made), lambda r: r.isNotNull())))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def fan_out_write(df: DataFrame, instance: str, path: str) -> None:
    """One scan and one write for all instances: a directory per value."""
    df.write.mode("overwrite").partitionBy(instance).parquet(path)


def slug(spark: SparkSession, text: str) -> str:
    """The slug of a branch name, by ``functions.slugify``."""
    return spark.range(1).select(slugify(F.lit(text))).first()[0]


def isolated_path(spark: SparkSession, path: str, branch: str) -> str:
    """``dir/name.ext`` becomes ``dir/name.preview.<slug>.ext``."""
    folder, name = posixpath.split(path.rstrip("/"))
    stem, dot, suffix = name.partition(".")
    return posixpath.join(folder, f"{stem}.preview.{slug(spark, branch)}{dot}{suffix}")


def isolated(spark: SparkSession, target: FileDataset, branch: str) -> FileDataset:
    """The same target, redirected to the branch's own path."""
    return target.at(isolated_path(spark, target.path, branch))
