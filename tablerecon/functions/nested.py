"""Nested values by name: conforming types, and laying a partial value over a stored one.

Structs go by field name, maps and JSON objects by key, at every level.  JSON is walked level
by level inside one expression, which loops as often as the document at hand is deep: the
expression is the same for any depth, and no row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.text import let

_OBJECT = "map<string,variant>"
_PAIRS = "array<struct<d:variant,p:variant,both:boolean>>"
_ITEM = "struct<parent:int,key:string,siblings:int,n:variant,o:variant,over:boolean,both:boolean>"
_VALUES = "array<struct<parent:int,key:string,siblings:int,value:variant>>"


def is_object(col: Column) -> Column:
    # A struct without fields fits every object and nothing else; what lies below is not visited.
    return F.try_variant_get(col, "$", "struct<>").isNotNull()


def conform(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """The same value in type ``want``: struct fields meet by name, missing ones are null."""
    if have == want:
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        fields = [
            (conform(col[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(col, lambda x: conform(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        same = F.transform_values(col, lambda _k, v: conform(v, have.valueType, want.valueType))
        return same if have.keyType == want.keyType else same.cast(want)
    return col.cast(want)


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """``a`` with the struct fields that only ``b`` has, at every level; other types stay."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        more = {f.name: f for f in b.fields}
        fields = [
            T.StructField(f.name, widened(f.dataType, more[f.name].dataType) if f.name in more else f.dataType)
            for f in a.fields
        ]
        have = {f.name for f in a.fields}
        return T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in b.fields if f.name not in have]])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(a.keyType, widened(a.valueType, b.valueType))
    return a


def merged(
    new: Column,
    old: Column,
    new_type: T.DataType,
    old_type: T.DataType,
    want: T.DataType,
) -> Column:
    """``old`` with everything that ``new`` holds laid over it; a null inside ``new`` is a value."""
    if isinstance(new_type, T.StructType) and isinstance(old_type, T.StructType) and isinstance(want, T.StructType):
        news = {f.name: f.dataType for f in new_type.fields}
        olds = {f.name: f.dataType for f in old_type.fields}
        fields = []
        for f in want.fields:
            c = f.name
            if c in news and c in olds:
                value = merged(new[c], old[c], news[c], olds[c], f.dataType)
            elif c in news:
                value = conform(new[c], news[c], f.dataType)
            else:
                value = conform(old[c], olds[c], f.dataType)
            fields.append(value.alias(c))
        both = F.struct(*fields)
    elif isinstance(new_type, T.MapType) and isinstance(old_type, T.MapType) and isinstance(want, T.MapType):
        key = want.keyType
        over = new if new_type.keyType == key else new.cast(T.MapType(key, new_type.valueType))
        under = old if old_type.keyType == key else old.cast(T.MapType(key, old_type.valueType))
        both = F.map_zip_with(
            under,
            over,
            lambda k, o, n: F.when(
                F.map_contains_key(over, k), merged(n, o, new_type.valueType, old_type.valueType, want.valueType)
            ).otherwise(conform(o, old_type.valueType, want.valueType)),
        )
    elif all(isinstance(x, T.VariantType) for x in (new_type, old_type, want)):
        both = _json_merged(new, old)
    else:
        return conform(new, new_type, want)
    alone = conform(new, new_type, want)
    return F.when(new.isNull(), F.lit(None).cast(want)).when(old.isNull(), alone).otherwise(both)


def _json_text(col: Column) -> Column:
    # A JSON null and a missing key are the same value here.
    return F.coalesce(F.to_json(col), F.lit("null"))


def _levels(text: Column) -> Column:
    """One step per object in the document's text: at least as many as it has levels."""
    return F.sequence(F.lit(0), F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))), F.lit(0)))


def _members(upper: Column, lower: Column) -> Column:
    """Members of two objects that meet by key: ``key``, and ``value`` with both sides and ``over``,
    whether the upper one has the key."""
    marked = F.transform_values(upper.cast(_OBJECT), lambda _k, v: F.struct(v.alias("v"), F.lit(True).alias("over")))
    met = F.map_zip_with(
        lower.cast(_OBJECT),
        marked,
        lambda _k, o, n: F.struct(n["v"].alias("n"), o.alias("o"), F.coalesce(n["over"], F.lit(False)).alias("over")),
    )
    return F.map_entries(met)


def json_differs(desired: Column, prior: Column) -> Column:
    """Whether anything that ``desired`` holds is another value in ``prior``, at any depth.

    Objects that meet are opened; only what is not an object on both sides is compared as text.
    """

    def pair(d: Column, p: Column) -> Column:
        return F.struct(d.alias("d"), p.alias("p"), (is_object(d) & is_object(p)).alias("both"))

    def held(x: Column) -> Column:
        # a JSON null is a variant; only a key that the desired object lacks is null here
        met = F.map_zip_with(x["d"].cast(_OBJECT), x["p"].cast(_OBJECT), lambda _k, n, o: F.struct(n.alias("n"), o.alias("o")))
        own = F.filter(F.map_values(met), lambda m: m["n"].isNotNull())
        return F.transform(own, lambda m: pair(m["n"], m["o"]))

    def step(state: Column, _i: Column) -> Column:
        def judged(members: Column) -> Column:
            hit = F.exists(members, lambda x: ~x["both"] & (_json_text(x["d"]) != _json_text(x["p"])))
            return F.struct(hit.alias("hit"), F.filter(members, lambda x: x["both"]).alias("open"))

        members = F.flatten(F.transform(state["open"], held))
        return F.when(state["hit"] | (F.size(state["open"]) == 0), state).otherwise(let(members, judged))

    def look(x: Column) -> Column:
        start = F.struct(F.lit(False).alias("hit"), F.array(x["root"]).cast(_PAIRS).alias("open"))
        walked = F.aggregate(_levels(x["text"]), start, step, lambda s: s["hit"])
        same = x["text"] == _json_text(x["root"]["p"])
        return F.when(same, F.lit(False)).when(x["root"]["both"], walked).otherwise(F.lit(True))

    return let(F.struct(pair(desired, prior).alias("root"), _json_text(desired).alias("text")), look)


def _item(parent: Column, key: Column, siblings: Column, n: Column, o: Column, over: Column) -> Column:
    return F.struct(
        parent.alias("parent"), key.alias("key"), siblings.alias("siblings"), n.alias("n"), o.alias("o"),
        over.alias("over"), (over & is_object(n) & is_object(o)).alias("both"),
    ).cast(_ITEM)


def _json_merged(new: Column, old: Column) -> Column:
    """``new`` over ``old``: objects that meet are opened level by level, then closed from below."""
    none, level_type = F.lit(None).cast("string"), f"array<{_ITEM}>"

    def opened(x: Column, i: Column) -> Column:
        """The members of both objects of item ``x``, the ``i``-th of its level."""
        members = let(
            _members(x["n"], x["o"]),
            lambda m: F.transform(
                m, lambda e: _item(i, e["key"], F.size(m), e["value"]["n"], e["value"]["o"], e["value"]["over"])
            ),
        )
        return F.when(x["both"], members).otherwise(F.array().cast(level_type))

    def down(levels: Column, _i: Column) -> Column:
        last = F.element_at(levels, -1)
        # no cast here: it would copy all levels at every step
        deeper = F.concat(levels, F.array(F.flatten(F.transform(last, opened))))
        return F.when(F.exists(last, lambda x: x["both"]), deeper).otherwise(levels)

    def up(values: Column, level: Column) -> Column:
        def closed(parents: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                # members stand side by side: the first one tells how many there are
                at = F.array_position(parents, i).cast("int")
                own = F.when(at > 0, F.slice(values, at, F.get(values, at - 1)["siblings"])).otherwise(F.slice(values, 1, 0))
                pairs = F.transform(own, lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))
                whole = F.to_variant_object(F.map_from_entries(pairs))
                return F.struct(
                    x["parent"].alias("parent"), x["key"].alias("key"), x["siblings"].alias("siblings"),
                    F.when(x["both"], whole).when(x["over"], x["n"]).otherwise(x["o"]).alias("value"),
                )

            return F.transform(level, value).cast(_VALUES)

        return let(F.transform(values, lambda c: c["parent"]), closed)

    def both(pair: Column) -> Column:
        root = _item(F.lit(-1), none, F.lit(1), pair["n"], pair["o"], F.lit(True))
        levels = F.aggregate(_levels(F.to_json(pair["n"])), F.array(F.array(root)).cast(f"array<{level_type}>"), down)
        values = F.aggregate(F.reverse(levels), F.array().cast(_VALUES), up)
        merged_all = F.element_at(values, 1)["value"]
        return F.when(is_object(pair["n"]) & is_object(pair["o"]), merged_all).otherwise(pair["n"])

    return let(F.struct(new.alias("n"), old.alias("o")), both)
