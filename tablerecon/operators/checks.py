"""Data-quality checks.

Every check returns its violations as rows ``(check, key, message)``; an empty
frame means valid.  Union them with ``violations`` and stop a job with
``assert_valid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import ValidationError
from tablerecon.functions.collections import any_of
from tablerecon.operators.lookups import least_of, value_at
from tablerecon.operators.skew import salted_join
from tablerecon.types import SQL_TYPES

# Patterns of names and colours.
NAME_PATTERN = "^[a-zA-Z0-9_]+$"
COLOR_PATTERN = "^#[0-9A-Fa-f]{6}$"

_SHOWN = 20


def key_text(keys: str | Sequence[str]) -> Column:
    """One or more key columns as text, joined by ``|``."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _rows(bad: DataFrame, check: str, keys: str | Sequence[str] | Column, message: Column) -> DataFrame:
    key = keys if isinstance(keys, Column) else key_text(keys)
    return bad.select(F.lit(check).alias("check"), key.alias("key"), message.alias("message"))


def violations(*frames: DataFrame) -> DataFrame:
    """All violation rows in one frame."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def assert_valid(found: DataFrame) -> None:
    """Raise when there is any violation.

    The message shows the first ones; ``violations`` of the error is the frame of all.
    """
    rows = found.limit(_SHOWN + 1).collect()
    if rows:
        shown = [f"[{r['check']}] {r['key']}: {r['message']}" for r in rows[:_SHOWN]]
        raise ValidationError(shown, more=len(rows) > _SHOWN, violations=found)


def check_pattern(
    df: DataFrame, col: str, pattern: str, keys: str | Sequence[str], check: str = "pattern"
) -> DataFrame:
    """Values that do not match; null is not a value."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).rlike(pattern))
    return _rows(bad, check, keys, F.concat(F.lit(f"{col} does not match: "), F.col(col)))


def check_non_empty(
    df: DataFrame, col: str, keys: str | Sequence[str], check: str = "non_empty"
) -> DataFrame:
    """Null or empty text; for lists also an empty list or an empty element."""
    value = F.col(col)
    if isinstance(df.schema[col].dataType, T.ArrayType):
        empty = value.isNull() | (F.size(value) == 0)
        inner = F.exists(value, lambda x: F.coalesce(F.length(x) == 0, F.lit(True)))
        message = F.when(empty, f"{col} is empty").otherwise(f"{col} has an empty element")
        return _rows(df.filter(empty | inner), check, keys, message)
    bad = df.filter(value.isNull() | (F.length(value) == 0))
    return _rows(bad, check, keys, F.lit(f"{col} is empty"))


def check_in_set(
    df: DataFrame, col: str, values: Sequence, keys: str | Sequence[str], check: str = "in_set"
) -> DataFrame:
    bad = df.filter(F.col(col).isNull() | ~F.col(col).isin(list(values)))
    return _rows(bad, check, keys, F.concat(F.lit(f"{col} not allowed: "), _text(F.col(col))))


def check_implies(
    df: DataFrame,
    when: Column,
    then: Column,
    keys: str | Sequence[str],
    message: str,
    check: str = "implies",
) -> DataFrame:
    """Rows where ``when`` holds and ``then`` does not; null counts as false."""
    holds = F.coalesce(when, F.lit(False))
    met = F.coalesce(then, F.lit(False))
    return _rows(df.filter(holds & ~met), check, keys, F.lit(message))


def exclusive(*cols: str) -> Column:
    """At most one of the columns is set."""
    return _set_count(cols) <= 1


def exactly_one(*cols: str) -> Column:
    return _set_count(cols) == 1


def _set_count(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def check_unique(
    df: DataFrame, keys: str | Sequence[str], check: str = "unique"
) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    names = [keys] if isinstance(keys, str) else list(keys)
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return _rows(counted, check, names, F.concat(F.lit("rows: "), F.col("__n").cast("string")))


def check_keys(df: DataFrame, keys: str | Sequence[str], check: str = "keys") -> DataFrame:
    """Keys that cannot name one row: those that occur more than once or hold a null."""
    names = [keys] if isinstance(keys, str) else list(keys)
    null = any_of([F.col(n).isNull() for n in names])
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    message = F.concat(F.when(null, "null in the key, rows: ").otherwise("rows: "), F.col("__n").cast("string"))
    return _rows(counted.filter((F.col("__n") > 1) | null), check, names, message)


def check_unique_in_group(
    df: DataFrame,
    group: str,
    name: str,
    address: str,
    position: str,
    check: str = "unique_in_group",
) -> DataFrame:
    """Every later row of the same (group, name) names the first holder.

    The first holder comes from aggregations, not a window, so a hot group is combined
    map-side; names used once drop out before any other row is looked at.  Of holders in
    the first position the smallest address is the first.
    """
    rows = df.select(
        F.col(group).alias("__group"), F.col(name).alias("__name"), F.col(address).alias("__address"), F.col(position).alias("__at")
    )
    many = rows.groupBy("__group", "__name").agg(F.count(F.lit(1)).alias("__n"), least_of(F.col("__at")).alias("__p"))
    many = many.filter("__n > 1").select(F.col("__group").alias("__g"), F.col("__name").alias("__m"), "__p")
    own = [("__group", "__g"), ("__name", "__m")]
    shared = salted_join(rows, many, own, "inner", null_safe=True)
    first = value_at(rows, ["__group", "__name"], "__address", many, [*own, ("__at", "__p")])
    first = first.select(F.col("__group").alias("__h"), F.col("__name").alias("__i"), F.col("__address").alias("__first"))
    later = salted_join(shared, first, [("__group", "__h"), ("__name", "__i")], "inner", null_safe=True)
    place = lambda at, who: F.struct(F.col(at).alias("pos"), F.col(who).alias("addr"))
    bad = later.filter(place("__at", "__address") > place("__p", "__first"))
    bad = bad.select(F.col("__group").alias(group), F.col("__name").alias(name), F.col("__address").alias(address), "__first")
    message = F.concat(
        F.lit("duplicate "), _text(F.col(group)), F.lit(" name '"), _text(F.col(name)),
        F.lit("': first held by "), F.col("__first").cast("string"),
    )
    return _rows(bad, check, address, message)


def check_reference(
    df: DataFrame,
    ref: str,
    universe: DataFrame | Sequence[DataFrame],
    universe_key: str,
    keys: str | Sequence[str],
    check: str = "reference",
) -> DataFrame:
    """References, scalar or list, that no universe holds."""
    frames = [universe] if isinstance(universe, DataFrame) else list(universe)
    known = frames[0].select(F.col(universe_key).alias("__ref"))
    for frame in frames[1:]:
        known = known.unionByName(frame.select(F.col(universe_key).alias("__ref")))
    value = F.col(ref)
    if isinstance(df.schema[ref].dataType, T.ArrayType):
        value = F.explode(value)
    wanted = df.select(key_text(keys).alias("__key"), value.alias("__ref")).filter(
        F.col("__ref").isNotNull()
    )
    # Distinct references meet the universe once each; only the missing ones
    # then go back to the rows that carry them.
    missing = (
        wanted.select("__ref").distinct().join(known, "__ref", "left_anti").withColumnRenamed("__ref", "__missing")
    )
    bad = salted_join(wanted, missing, [("__ref", "__missing")], "inner")
    message = F.concat(F.lit("unknown reference: "), F.col("__ref").cast("string"))
    return _rows(bad, check, F.col("__key"), message)


def check_typed_reference(
    df: DataFrame,
    ref: str,
    view: DataFrame,
    view_name: str,
    view_type: str,
    keys: str | Sequence[str],
    type_is: str | None = None,
    type_suffix: str | None = None,
    check: str = "typed_reference",
) -> DataFrame:
    """References that must exist as a given type, or type suffix."""
    known = view
    if type_is is not None:
        known = known.filter(F.col(view_type) == type_is)
    if type_suffix is not None:
        known = known.filter(F.col(view_type).endswith(type_suffix))
    return check_reference(df, ref, known, view_name, keys, check)


def check_any_member(
    members: DataFrame,
    keys: str | Sequence[str],
    satisfied: Column,
    message: str,
    check: str = "any_member",
    owners: DataFrame | None = None,
) -> DataFrame:
    """Keys none of whose members satisfies the predicate.

    With ``owners`` a key without any member is a violation too.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    per_key = members.groupBy(*names).agg(F.bool_or(satisfied).alias("__ok"))
    if owners is not None:
        per_key = owners.select(*names).join(per_key, names, "left")
    bad = per_key.filter(~F.coalesce(F.col("__ok"), F.lit(False)))
    return _rows(bad, check, names, F.lit(message))


def sql_capable(ref: Column, dataset_type: Column, is_foreign: Column) -> Column:
    """Whether a recipe input can be read by SQL.

    Its type is a SQL one, or it is foreign, or it names another project: the
    type of the last two is not known here.
    """
    known = F.coalesce(dataset_type.isin(*SQL_TYPES), F.lit(False))
    foreign = F.coalesce(is_foreign, F.lit(False))
    return known | foreign | F.contains(ref, F.lit("."))


def check_functional_dependency(
    df: DataFrame, key: str | Sequence[str], value: str, check: str = "functional_dependency"
) -> DataFrame:
    """Keys that carry two different values; both ends are named.

    ``min`` and ``max`` combine map-side, so no key's values meet in one task.
    """
    names = [key] if isinstance(key, str) else list(key)
    ends = df.groupBy(*names).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    message = F.concat(
        F.lit("conflicting values: "), F.col("__lo").cast("string"), F.lit(" vs "), F.col("__hi").cast("string")
    )
    return _rows(ends.filter("__lo <> __hi"), check, names, message)


def check_not_self(
    df: DataFrame, own: str, target: str, keys: str | Sequence[str], check: str = "not_self"
) -> DataFrame:
    """Rows whose target, scalar or list, is the row's own id."""
    if isinstance(df.schema[target].dataType, T.ArrayType):
        hit = F.array_contains(F.col(target), F.col(own))
    else:
        hit = F.col(target) == F.col(own)
    message = F.concat(F.lit(f"{target} includes own id "), F.col(own).cast("string"))
    return _rows(df.filter(F.coalesce(hit, F.lit(False))), check, keys, message)


def valid_grants(objects: DataFrame, rules: DataFrame, object_cols: Sequence[str]) -> DataFrame:
    """Sharing rules whose object exists."""
    have = objects.select(*[F.col(c).alias(f"__o_{c}") for c in object_cols])
    return salted_join(rules, have, [(c, f"__o_{c}") for c in object_cols], "left_semi")


def check_granted(
    refs: DataFrame,
    objects: DataFrame,
    rules: DataFrame,
    keys: str | Sequence[str],
    object_cols: Sequence[str],
    target: str,
    check: str = "granted",
) -> DataFrame:
    """References whose object is missing, or not shared with ``target``."""
    on = [*object_cols, target]
    granted = valid_grants(objects, rules, object_cols).select(*[F.col(c).alias(f"__g_{c}") for c in on])
    bad = salted_join(refs, granted.distinct(), [(c, f"__g_{c}") for c in on], "left_anti")
    what = F.concat_ws(".", *[F.col(c).cast("string") for c in object_cols])
    message = F.concat(F.lit("missing or not shared: "), what, F.lit(" to "), F.col(target).cast("string"))
    return _rows(bad, check, keys, message)


def check_in_registry(
    df: DataFrame,
    col: str,
    registry: DataFrame,
    registry_col: str,
    kind_col: str,
    kind: object,
    keys: str | Sequence[str],
    check: str = "in_registry",
) -> DataFrame:
    """Values a registry of one kind does not hold; null is not a value."""
    known = registry.filter(F.col(kind_col) == kind)
    return check_reference(df, col, known, registry_col, keys, check)


def check_flags(
    df: DataFrame, rules: dict[str, Column], keys: str | Sequence[str], check: str = "rule"
) -> DataFrame:
    """Many row rules in one pass: a violation row for each rule that is not met."""
    flags = F.array(
        *[F.when(~F.coalesce(met, F.lit(False)), F.lit(text)) for text, met in rules.items()]
    )
    unmet = any_of([~F.coalesce(met, F.lit(False)) for met in rules.values()])
    bad = df.filter(unmet).select(
        key_text(keys).alias("__key"),
        F.explode(F.filter(flags, lambda m: m.isNotNull())).alias("__message"),
    )
    return _rows(bad, check, F.col("__key"), F.col("__message"))
