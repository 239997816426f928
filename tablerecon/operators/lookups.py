"""Joins and lookups over keyed tables.

No join here carries a broadcast hint: Spark broadcasts a side only when its
measured size is below the session threshold and shuffles it otherwise.  Lookup
sides are reduced to one row per key by aggregations that combine map-side, so
a hot key costs one partial row per task; how the many-rows side is kept from
filling one task is told in ``operators.skew``.  Each lookup takes the ``join`` to
use for it: ``salted_join``, or ``sketched_join`` where that side is a stored table
whose layout is worth keeping.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.compare import opaque as _opaque
from tablerecon.operators.skew import Join, salted_join
from tablerecon.session import materialize

# Alias sets up to this size are inlined as a literal map; larger ones join.
INLINE_ALIASES = 256


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def least_of(place: Column, among: Column | None = None) -> Column:
    """The smallest place, null before all others, of the rows ``among``.

    Numeric minima and sums aggregate in place; a minimum by a struct would sort all rows.
    """
    among = F.lit(True) if among is None else among
    nulls = F.coalesce(F.sum((among & place.isNull()).cast("int")), F.lit(0))
    return F.when(nulls == 0, F.min(F.when(among, place)))


def value_at(rows: DataFrame, keys: Sequence[str], value: str, places: DataFrame, match: Sequence[tuple[str, str]], join: Join = salted_join) -> DataFrame:
    """``(<keys>, <value>)`` of the rows that stand where ``places`` says, one per key.

    Of several rows in one place the smallest value counts; null where all are null.
    """
    there = join(rows, places, match, "left_semi", null_safe=True)
    dtype = rows.schema[value].dataType
    one = F.first(value) if _opaque(dtype) else F.array_min(F.collect_set(value))
    return there.groupBy(*keys).agg(one.alias(value))


def left_enrich(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    suffix: str = "_ref",
    fill: Mapping[str, object] | None = None,
    null_safe: bool = False,
    join: Join = salted_join,
) -> DataFrame:
    """Left join; right columns whose names clash get ``suffix``.

    ``fill`` names result columns taken from the right side with a default for
    rows without a match, or for a right side without that column.
    """
    keys = _names(on)
    fill = dict(fill or {})
    extra = [c for c in right.columns if c not in keys]
    renamed = {c: c + suffix if c in left.columns else c for c in extra}
    side = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c).alias(f"__v_{c}") for c in extra],
    )
    joined = join(left, side, [(k, f"__r_{k}") for k in keys], "left", null_safe)

    def filled(name: str) -> Column:
        default = F.lit(fill[name])
        return F.coalesce(F.col(f"__v_{name}"), default) if name in extra else default

    out = [filled(c).alias(c) if c in fill else F.col(c) for c in left.columns]
    out += [
        filled(c).alias(c) if c in fill and renamed[c] == c else F.col(f"__v_{c}").alias(renamed[c])
        for c in extra
    ]
    out += [filled(c).alias(c) for c in fill if c not in left.columns and c not in extra]
    return joined.select(*out)


def overlay(
    desired: DataFrame,
    prior: DataFrame,
    keys: str | Sequence[str],
    position: str | None = None,
) -> DataFrame:
    """Both sides in one view; prior rows whose key is desired are hidden.

    ``candidate_rank`` orders candidates of equal name: desired before prior,
    and among desired rows the one declared last first.
    """
    on = _names(keys)
    pos = F.col(position) if position else F.lit(0)
    first = desired.withColumn("candidate_rank", F.struct(F.lit(0).alias("side"), (-pos).alias("pos")))
    rest = prior.join(desired.select(*on).distinct(), on, "left_anti").withColumn(
        "candidate_rank", F.struct(F.lit(1).alias("side"), pos.alias("pos"))
    )
    return first.unionByName(rest, allowMissingColumns=True)


def lookup_first(
    refs: DataFrame,
    view: DataFrame,
    name: str,
    attr: str,
    type_col: str | None = None,
    type_is: str | None = None,
    type_suffix: str | None = None,
    out: str | None = None,
    ref: str | None = None,
    join: Join = salted_join,
) -> DataFrame:
    """Attribute of the first matching candidate in an ``overlay`` view.

    A first match whose attribute is null gives null; later candidates are not
    tried.
    """
    candidates = view
    if type_is is not None:
        candidates = candidates.filter(F.col(type_col) == type_is)
    if type_suffix is not None:
        candidates = candidates.filter(F.col(type_col).endswith(type_suffix))
    candidates = candidates.select(
        F.col(name).alias("__name"),
        F.col(attr).alias("__v"),
        F.col("candidate_rank.side").alias("__side"),
        F.col("candidate_rank.pos").alias("__pos"),
    )
    side, pos = F.col("__side"), F.col("__pos")
    ranks = candidates.groupBy("__name").agg(
        F.min(side).alias("__s"), least_of(pos, side == 0).alias("__p0"), least_of(pos, side == 1).alias("__p1")
    )
    first = ranks.select(F.col("__name").alias("__n"), "__s", F.when(F.col("__s") == 0, F.col("__p0")).otherwise(F.col("__p1")).alias("__p"))
    best = value_at(candidates, ["__name"], "__v", first, [("__name", "__n"), ("__side", "__s"), ("__pos", "__p")], join)
    joined = join(refs, best, [(ref or name, "__name")], "left")
    return joined.select(*refs.columns, F.col("__v").alias(out or attr))


def lookup_last(
    refs: DataFrame,
    table: DataFrame,
    name: str,
    value: str,
    position: str,
    ref: str | None = None,
    out: str | None = None,
    join: Join = salted_join,
) -> DataFrame:
    """Value of the last row, by position, that carries the name."""
    rows = table.select(F.col(name).alias("__name"), F.col(value).alias("__v"), F.col(position).alias("__pos"))
    last = rows.groupBy("__name").agg(F.max("__pos").alias("__p")).withColumnRenamed("__name", "__n")
    best = value_at(rows, ["__name"], "__v", last, [("__name", "__n"), ("__pos", "__p")], join)
    joined = join(refs, best, [(ref or name, "__name")], "left")
    return joined.select(*refs.columns, F.col("__v").alias(out or value))


def resolve_refs(
    nodes: DataFrame,
    refs: DataFrame,
    address: str = "address",
    type_col: str = "resource_type",
    name: str = "name",
    depends_on: str | None = "depends_on",
    join: Join = salted_join,
) -> DataFrame:
    """Dependency edges: explicit ones first, then those found by reference.

    ``nodes`` holds one row per address.  ``refs`` holds (address, ref_name,
    ref_type or null, position).  A typed reference matches type and name, an
    untyped one the name alone, so it may match one node per type.  Self edges
    are left out for references.  Each edge comes once:
    ``(address, dep, explicit, position)`` with its first position among the
    explicit ones, or else among the references.
    """
    by_name = nodes.select(
        F.col(address).alias("dep"), F.col(type_col).alias("__type"), F.col(name).alias("__name")
    )
    wanted = refs.select(
        F.col("address"),
        F.col("ref_name"),
        F.col("ref_type"),
        F.col("position").cast("long").alias("__pos"),
    )
    # One equi-join on the name serves both kinds; the type is a residual test.
    matched = join(wanted, by_name, [("ref_name", "__name")], "inner").filter(
        (F.col("ref_type").isNull() | (F.col("ref_type") == F.col("__type")))
        & (F.col("dep") != F.col("address"))
    )
    found = matched.select("address", "dep", F.lit(None).cast("long").alias("__own"), "__pos")
    if depends_on is not None:
        explicit = nodes.select(
            F.col(address).alias("address"), F.posexplode(F.col(depends_on)).alias("__p", "dep")
        ).select("address", "dep", F.col("__p").cast("long").alias("__own"), F.lit(None).cast("long").alias("__pos"))
        found = explicit.unionByName(found)
    # Two numeric minima aggregate in place; a struct minimum would need a sort.
    first = found.groupBy("address", "dep").agg(F.min("__own").alias("__own"), F.min("__pos").alias("__pos"))
    return first.select(
        "address",
        "dep",
        F.col("__own").isNotNull().alias("explicit"),
        F.coalesce("__own", "__pos").alias("position"),
    )


def resolve_aliases(
    df: DataFrame,
    list_cols: Sequence[str],
    aliases: DataFrame,
    name: str = "name",
    target: str = "target",
    inline_limit: int = INLINE_ALIASES,
    join: Join = salted_join,
) -> DataFrame:
    """Replace list elements by their alias target; order and others are kept.

    A name with several targets stands for the smallest; aliases without a name or
    a target do nothing.  A small alias set, checked by reading at most
    ``inline_limit + 1`` rows, becomes a literal map and needs no shuffle.  A larger
    one is joined to the exploded elements, which are then gathered again per row, so
    a group is never longer than one row's own list.  Both give the same rows.
    """
    known = aliases.filter(F.col(name).isNotNull() & F.col(target).isNotNull())
    known = known.groupBy(F.col(name).alias("__name")).agg(F.min(target).alias("__target"))
    pairs = known.limit(inline_limit + 1).collect()
    if len(pairs) <= inline_limit:
        if not pairs:
            return df
        table = F.create_map(*[F.lit(v) for row in pairs for v in (row[0], row[1])])
        return df.withColumns(
            {
                c: F.transform(c, lambda x: F.coalesce(F.try_element_at(table, x), x))
                for c in list_cols
            }
        )
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "alias-rows")
    pieces = [
        rows.filter(F.size(c) > 0).select(
            "__row", F.lit(c).alias("__col"), F.posexplode(c).alias("__pos", "__elem")
        )
        for c in list_cols
    ]
    elements = pieces[0]
    for piece in pieces[1:]:
        elements = elements.unionByName(piece)
    resolved = join(elements, known, [("__elem", "__name")], "left").select(
        "__row", "__col", "__pos", F.coalesce("__target", "__elem").alias("__value")
    )
    gathered = resolved.groupBy("__row").agg(
        *[
            F.sort_array(
                F.collect_list(
                    F.when(F.col("__col") == c, F.struct(F.col("__pos"), F.col("__value")))
                )
            ).alias(f"__new_{c}")
            for c in list_cols
        ]
    )
    back = rows.join(gathered, "__row", "left")
    return back.withColumns(
        {
            c: F.when(F.size(F.col(c)) > 0, F.transform(f"__new_{c}", lambda s: s["__value"])).otherwise(
                F.col(c)
            )
            for c in list_cols
        }
    ).select(*df.columns)


def layered_merge(
    scopes: Sequence[DataFrame],
    name: str = "name",
    value: str = "value",
    position: str = "position",
    by: Sequence[str] = (),
    kind: str | None = None,
    join: Join = salted_join,
) -> DataFrame:
    """Merge key/value scopes, lowest first: later scopes override earlier ones.

    Only text values take part: a null value, or one whose ``kind`` column is
    not ``'string'``, neither sets nor hides anything.  A name keeps the
    position of its first insertion, as (scope, position).
    """
    parts = []
    for rank, scope in enumerate(scopes):
        if not isinstance(scope.schema[value].dataType, T.StringType):
            continue
        use = F.col(value).isNotNull()
        if kind is not None:
            use = use & (F.col(kind) == "string")
        parts.append(
            scope.filter(use).select(
                *by,
                F.col(name).alias("name"),
                F.col(value).alias("value"),
                F.lit(rank).alias("__scope"),
                F.col(position).cast("long").alias("__pos"),
            )
        )
    if not parts:
        raise ValueError("no scope holds text values")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    keys, scope, pos = [*by, "name"], F.col("__scope"), F.col("__pos")
    # Numbers only: the outermost scopes of a name, and in each scope its outermost places.
    bounds = [
        c
        for i in range(len(scopes))
        for c in (least_of(pos, scope == i).alias(f"__lo{i}"), F.max(F.when(scope == i, pos)).alias(f"__hi{i}"))
    ]
    found = every.groupBy(*keys).agg(F.min(scope).alias("__first"), F.max(scope).alias("__last"), *bounds)
    lows = F.get(F.array(*[F.col(f"__lo{i}") for i in range(len(scopes))]), F.col("__first"))
    highs = F.get(F.array(*[F.col(f"__hi{i}") for i in range(len(scopes))]), F.col("__last"))
    found = found.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.struct(F.col("__first").alias("scope"), lows.alias("position")).alias("position"),
        "__last",
        highs.alias("__high"),
    )
    own = [(k, f"__k_{k}") for k in keys]
    values = value_at(every, keys, "value", found, [*own, ("__scope", "__last"), ("__pos", "__high")], join)
    joined = join(values, found.drop("__last", "__high"), own, "inner", null_safe=True)
    return joined.select(*keys, "value", "position")
