"""A versioned table on a shared path, with plan, apply, upsert and refresh.

Layout under the path::

    data/<id>/__part=<p>/   immutable Parquet folders, one per writing and part
    log/                    what each version wrote, see ``plans.log``

A row's part is a hash of its key.  A part has base rows and deltas: later rows, and
tombstones of deleted keys.  Readers take the last delta row of a key and the base rows no
delta replaces.  So a batch writes its own rows and no others; a part is written anew, within
a later batch, once its deltas have ``share`` of its rows, and all parts are when a column
joins the table.  Parts split one after the other (linear hashing) as the table grows, and
only the part that splits is written.

Each part carries the sums of its rows' hashes.  They follow from the changes, tell without
a join which parts a live table differs in, and make up the digest.

A version exists once its log entry is in place, which happens after its data is complete.
Old versions are never changed, so a running reader is not disturbed, until ``sweep`` removes
those no longer kept.  Several writers may work at once: an entry's place can be taken once;
who comes second lays its parts over the winner's version, or is refused where both wrote the
same part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.errors import ReconError, StalePlanError
from tablerecon.functions.collections import any_of
from tablerecon.functions.compare import comparable, differs
from tablerecon.functions.hashing import row_hash
from tablerecon.functions.nested import conform
from tablerecon.functions.templates import Variables
from tablerecon.operators.checks import assert_valid
from tablerecon.operators.digest import SUM_COLUMNS, bucket_sums, digest_text
from tablerecon.plans.apply import apply_changes, check_plan, next_columns, snapshot_schema, with_timestamps
from tablerecon.plans.changes import (
    ACTIONABLE,
    ACTIONS,
    TIMESTAMPS,
    key_names,
    moment,
    plan,
    plan_destroy,
    plan_upserts,
    refuse_duplicates,
)
from tablerecon.plans.drift import drift
from tablerecon.plans.log import WHOLE_EVERY, Version, VersionLog
from tablerecon.session import is_missing_path, materialize, scratch_path

PARTS = 8
PART_ROWS = 2_000_000
SHARE = 0.25
MOST_DELTAS = 16  # of one part, before it is written anew

# Per column the order of the value a key holds; kept with the rows, never shown.
MARKS = "__marks"

_PART, _WRITE, _GONE = "__part", "__write", "__gone"
_DELTA_FIELDS = [T.StructField(_WRITE, T.LongType()), T.StructField(_GONE, T.BooleanType())]
_SUM_NAMES = ["rows", *SUM_COLUMNS]
_ZERO = [0] * len(_SUM_NAMES)

_HISTORY_DDL = (
    "seq long, lineage string, serial long, digest string, rows long, batch string, created string, put array<int>"
)
_PLAN_DDL = (
    "lineage string, serial long, digest string, destroy boolean, created string, "
    "counts map<string, long>, seq long"
)


class Moves(NamedTuple):
    """Changes of the hash sums, by bucket and by part, and how many rows came or went per part."""

    buckets: dict[str, list[int]]
    parts: dict[int, list[int]]
    gross: dict[int, int]


def _tuple(record: object) -> tuple:
    return tuple(getattr(record, f.name) for f in fields(record))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _plus(a: Sequence[int] | None, b: Sequence[int] | None) -> list[int]:
    return [x + y for x, y in zip(a or _ZERO, b or _ZERO, strict=True)]


def _minus(a: Sequence[int] | None, b: Sequence[int] | None) -> list[int]:
    return [x - y for x, y in zip(a or _ZERO, b or _ZERO, strict=True)]


def _shifted(base: Mapping[str, list[int]], moved: Mapping[str, list[int]]) -> dict[str, list[int]]:
    """Bucket sums after a change; buckets without rows drop out."""
    every = {b: _plus(base.get(b), moved.get(b)) for b in {*base, *moved}}
    return {b: s for b, s in every.items() if s[0]}


def _new_part(part: int, path: str | None) -> dict:
    return {"part": part, "path": path, "rows": 0, "deltas": [], "delta_rows": 0, "sums": list(_ZERO)}


def grown(modulus: int, split: int, rows: int, part_rows: int) -> tuple[int, int, list[tuple[int, int]]]:
    """The layout after splitting until parts hold ``part_rows`` on average, and the splits
    ``(part, step)``: rows of the part stay in it or go to part + step."""
    splits = []
    while rows > part_rows * (modulus + split):
        splits.append((split, modulus))
        split += 1
        if split == modulus:
            modulus, split = 2 * modulus, 0
    return modulus, split, splits


def _batch_number(batch: str) -> tuple[str, int]:
    """``name-7`` is batch 7 of stream ``name``; other ids are streams of one batch."""
    name, _, number = batch.rpartition("-")
    return (name, int(number)) if name and number.isdigit() else (batch, 0)


def _with_batch(streams: Mapping[str, int], batch: str | None) -> dict[str, int]:
    if batch is None:
        return dict(streams)
    name, number = _batch_number(batch)
    return dict(streams) | {name: max(number, streams.get(name, -1))}


def reduced(rows: DataFrame, keys: Sequence[str], order: str, own: Sequence[str], null_desired: str) -> DataFrame:
    """One row per key; each column as ``(mark, value, seen)``, the value of the highest order.

    An aggregation, not a window: a hot key is reduced to one row per task before the shuffle.
    """
    missing = F.raise_error(F.lit(f"a row has no {order}")).cast(rows.schema[order].dataType)
    mark = F.coalesce(F.col(order), missing)
    found = []
    for c in own:
        rank = F.struct(mark.alias("mark"), comparable(F.col(c), rows.schema[c].dataType).alias("value"))
        rank = F.when(F.col(c).isNotNull(), rank) if null_desired == "unmanaged" else rank
        value = F.struct(mark.alias("mark"), F.col(c).alias("value"), F.lit(True).alias("seen"))
        found.append(F.max_by(value, rank).alias(c))
    if not found:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*found)


@dataclass(frozen=True)
class PlanMeta:
    """What a plan was made against."""

    lineage: str
    serial: int
    digest: str
    destroy: bool
    created: str
    # Rows per action, known once the plan has been saved.
    counts: dict[str, int] | None = None
    seq: int | None = None


@dataclass(frozen=True)
class Plan:
    changes: DataFrame
    meta: PlanMeta
    stored: bool = False


def save_plan(made: Plan, path: str, actionable_only: bool = True) -> None:
    """Write a plan; no-ops carry nothing an apply needs and are left out.

    Rows per action, no-ops too, are counted while the rows are written.
    """
    spark = made.changes.sparkSession
    seen = Observation()
    counts = [F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ACTIONS]
    rows = made.changes.observe(seen, *counts)
    if actionable_only:
        rows = rows.filter(F.col("action") != "no-op")
    rows.write.parquet(f"{path}/changes")
    meta = replace(made.meta, counts=dict(seen.get))
    spark.createDataFrame([_tuple(meta)], _PLAN_DDL).coalesce(1).write.parquet(f"{path}/meta")


def load_plan(spark: SparkSession, path: str) -> Plan:
    meta = spark.read.schema(_PLAN_DDL).parquet(f"{path}/meta").first()
    return Plan(spark.read.parquet(f"{path}/changes"), PlanMeta(**meta.asDict()), True)


class TableStore:
    """A keyed table whose every applied change set becomes a new version."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: str | Sequence[str],
        strategies: Mapping[str, str] | None = None,
        ignore: Sequence[str] = (),
        null_desired: str = "unmanaged",
        parts: int | None = None,
        part_rows: int = PART_ROWS,
        share: float = SHARE,
    ) -> None:
        """
        parts      how many parts a new table has at least
        part_rows  parts are split one by one so that they hold so many rows on average
        share      a part is written anew once its deltas have this share of its rows
        """
        self.parts = parts
        self.part_rows = part_rows
        self.share = share
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = key_names(keys)
        self.strategies = dict(strategies or {})
        self.ignore = tuple(ignore)
        self.null_desired = null_desired
        self.log = VersionLog(spark, f"{self.path}/log")

    # Versions.

    def versions(self) -> DataFrame:
        """One row per version that was not swept."""
        try:
            return self.spark.read.schema(_HISTORY_DDL).json(f"{self.path}/log/*/*.json")
        except AnalysisException as e:
            if not is_missing_path(e):
                raise
            return self.spark.createDataFrame([], _HISTORY_DDL)

    def current(self) -> Version | None:
        return self.log.newest()

    def require(self) -> Version:
        found = self.current()
        if found is None:
            raise ReconError(f"no version at {self.path}")
        return found

    def version(self, seq: int) -> Version:
        """An earlier version."""
        found = self.log.load(seq)
        if found is None:
            raise ReconError(f"version {seq} of {self.path} is not kept")
        return found

    def read(self, version: Version | None = None) -> DataFrame:
        rows = self._read(version or self.require())
        return rows.drop(MARKS)

    def _read(self, at: Version, only: Collection[int] | None = None) -> DataFrame:
        """A version's rows, or those of some parts: base rows that no delta replaces, then
        the last delta row of each key, unless it is a tombstone."""
        schema = T.StructType.fromJson(json.loads(at.schema))
        parts = [p for p in at.parts if only is None or p["part"] in only]
        bases = [p["path"] for p in parts if p["path"]]
        deltas = sorted({d for p in parts for d in p["deltas"]})
        empty = self.spark.createDataFrame([], schema)
        base = self.spark.read.schema(schema).parquet(*bases) if bases else empty
        if not deltas:
            return base
        late = self.spark.read.schema(T.StructType([*schema.fields, *_DELTA_FIELDS])).parquet(*deltas)
        kept = base.join(late.select(*self.keys).distinct(), self.keys, "left_anti")
        if any(len(p["deltas"]) > 1 for p in parts):
            last = late.groupBy(*[F.col(k).alias(f"__k_{k}") for k in self.keys]).agg(F.max(_WRITE).alias("__last"))
            match = [F.col(k) == F.col(f"__k_{k}") for k in self.keys]
            late = late.join(last, [*match, F.col(_WRITE) == F.col("__last")], "left_semi")
        return kept.select(*schema.names).unionByName(late.filter(~F.col(_GONE)).select(*schema.names))

    def _part(self, modulus: int, split: int) -> Column:
        """The part of a row: its key hash modulo ``modulus``, and of parts already split modulo twice that."""
        h = F.xxhash64(*self.keys)
        p = F.pmod(h, F.lit(modulus))
        return (F.when(p < split, F.pmod(h, F.lit(2 * modulus))).otherwise(p) if split else p).cast("int")

    def _moves(self, frames: Sequence[tuple[int, DataFrame]], modulus: int, split: int) -> Moves:
        """What rows add to (1) or take from (-1) the sums, per hash bucket and per part: one job,
        256 rows and one per touched part."""
        every: DataFrame | None = None
        for sign, df in frames:
            part = self._part(modulus, split).alias("part")
            hashed = df.select(part, row_hash(df.select(*self._hashed(df))).alias("row_hash"))
            sums = bucket_sums(hashed, by=["part"]).withColumn("sign", F.lit(sign))
            every = sums if every is None else every.unionByName(sums)
        signed = [F.sum(F.col(c) * F.col("sign")).alias(c) for c in _SUM_NAMES]
        # grouping sets: the same rows by bucket and by part
        split_up = every.select(
            F.explode(F.array(
                F.struct(F.col("bucket").alias("bucket"), F.lit(None).cast("int").alias("part")),
                F.struct(F.lit(None).cast("string").alias("bucket"), F.col("part").alias("part")),
            )).alias("by"), "sign", *_SUM_NAMES,
        )
        rows = split_up.groupBy("by.bucket", "by.part").agg(*signed, F.sum("rows").alias("gross")).collect()
        return Moves(
            {r["bucket"]: [r[c] for c in _SUM_NAMES] for r in rows if r["bucket"] is not None},
            {r["part"]: [r[c] for c in _SUM_NAMES] for r in rows if r["part"] is not None},
            {r["part"]: r["gross"] for r in rows if r["part"] is not None},
        )

    def _hashed(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (*TIMESTAMPS, MARKS)]

    def _digest(self, sums: Mapping[str, Sequence[int]], lineage: str, serial: int) -> str:
        return digest_text(sums, {"lineage": lineage, "serial": serial})

    def _store(self, df: DataFrame, modulus: int, split: int) -> str:
        """Write rows into one folder per part; returns the folder above."""
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        # AQE gives every part as many files as it needs, and small ones one.
        df.withColumn(_PART, self._part(modulus, split)).hint("rebalance", _PART).write.partitionBy(_PART).parquet(data)
        return data

    def _from_rows(self, df: DataFrame, modulus: int, split: int, old: Version | None = None, **more: object) -> Version:
        """A version whose every part is written anew."""
        data = self._store(df, modulus, split)
        held = [int(n.split("=")[1]) for n in self.log.names(data) if n.startswith(f"{_PART}=")]
        parts = [_new_part(p, f"{data}/{_PART}={p}") for p in held]
        made = Version(0, "", 0, "", 0, df.schema.json(), modulus, split, parts, {})
        moves = self._moves([(1, self._read(made))], modulus, split)
        for p in parts:
            p["sums"] = moves.parts[p["part"]]
            p["rows"] = p["sums"][0]
        if old is not None:
            parts += [_new_part(p["part"], None) for p in old.parts if p["part"] not in held]
        parts.sort(key=lambda p: p["part"])
        rows = sum(p["rows"] for p in parts)
        return replace(made, parts=parts, sums=moves.buckets, rows=rows, put=[p["part"] for p in parts], **more)

    def _land(self, made: Version, wrote: set[int], steps: int, since: Version, rebase: bool) -> Version:
        """Add ``made`` to the log.  Where other writers were first and wrote none of its parts,
        its changes are laid over theirs."""
        while True:
            done = replace(made, digest=self._digest(made.sums, made.lineage, made.serial), created=_now())
            if self.log.add(done):
                return done
            now = self.require()
            try:
                met = self.log.put_since(since.seq, now.seq) & wrote
            except KeyError:
                met = wrote
            same = (now.lineage, now.schema) == (since.lineage, since.schema) == (made.lineage, made.schema)
            if not rebase or met or not same or self._resplit(since, made, now):
                raise StalePlanError("serial changed; plan again")
            mine = made.numbered()
            parts = now.numbered() | {p: mine[p] for p in wrote if p in mine}
            moved = {b: _minus(made.sums.get(b), since.sums.get(b)) for b in {*made.sums, *since.sums}}
            made = replace(
                made,
                seq=now.seq + 1,
                serial=now.serial + steps,
                parts=[parts[i] for i in sorted(parts)],
                sums=_shifted(now.sums, moved),
                rows=now.rows + made.rows - since.rows,
                modulus=now.modulus if (made.modulus, made.split) == (since.modulus, since.split) else made.modulus,
                split=now.split if (made.modulus, made.split) == (since.modulus, since.split) else made.split,
                streams=now.streams | {k: v for k, v in made.streams.items() if v > now.streams.get(k, -1)},
            )
            since = now

    @staticmethod
    def _resplit(since: Version, made: Version, now: Version) -> bool:
        """Whether both writers split parts."""
        layout = lambda v: (v.modulus, v.split)
        return layout(made) != layout(since) and layout(now) != layout(since)

    def create(self, df: DataFrame, now: Column | datetime | None = None, lineage: str | None = None) -> Version:
        """The first version, from a full table."""
        if self.current() is not None:
            raise ReconError(f"{self.path} already holds a table")
        refuse_duplicates(df, self.keys, "table")
        first = df if set(TIMESTAMPS) <= set(df.columns) else with_timestamps(df, now)
        parts = self.parts or max(PARTS, -(-df.count() // self.part_rows))
        lineage = lineage or str(uuid.uuid4())
        made = self._from_rows(first, parts, 0, lineage=lineage)
        made = replace(made, digest=self._digest(made.sums, lineage, 0), created=_now())
        if not self.log.add(made):
            raise ReconError(f"{self.path} already holds a table")
        return made

    # Plan and apply.

    def plan(
        self,
        desired: DataFrame,
        variables: Variables | None = None,
        destroy: bool = False,
        deletes: bool = True,
        check_keys: bool = True,
    ) -> Plan:
        at = self.require()
        prior = self.read(at)
        if check_keys:
            refuse_duplicates(desired, self.keys, "desired")
        if destroy:
            changes = plan_destroy(prior, self.keys)
        else:
            build = plan if deletes else plan_upserts
            changes = build(
                desired,
                prior,
                self.keys,
                strategies=self.strategies,
                ignore=self.ignore,
                null_desired=self.null_desired,
                variables=variables,
            )
        return Plan(changes, PlanMeta(at.lineage, at.serial, at.digest, destroy, _now(), seq=at.seq))

    def stale_reason(self, made: Plan, verify: bool = False) -> str | None:
        """Why the plan no longer fits; ``verify`` digests the data again."""
        return self._stale(made, self.require(), verify)

    def _stale(self, made: Plan, at: Version, verify: bool) -> str | None:
        if verify:
            found = self._moves([(1, self._read(at))], at.modulus, at.split)
            at = replace(at, digest=self._digest(found.buckets, at.lineage, at.serial))
        moved = [f for f in ("lineage", "serial", "digest") if getattr(made.meta, f) != getattr(at, f)]
        return f"{moved[0]} changed" if moved else None

    def apply(
        self,
        made: Plan,
        now: Column | datetime | None = None,
        verify: bool = False,
        batch: str | None = None,
        rebase: bool = False,
    ) -> Version:
        """Write the next version; all changes of the plan or none.

        ``rebase`` also takes a plan made before other versions landed, if these wrote none of
        the parts it changes.  What such a plan says of other rows, above all which of them are
        to be deleted, is as of when it was made.
        """
        at = self.require()
        reason = self._stale(made, at, verify)
        since = at
        if reason is not None:
            since = self._base_of(made, at) if rebase else None
            if since is None:
                raise StalePlanError(f"{reason}; plan again")
        made = self._stored(made)
        assert_valid(self._check(made.changes, at))
        steps = sum(n for a, n in (made.meta.counts or {}).items() if a in ACTIONABLE)
        if not steps:
            # Nothing to write, but a batch must be known as done.
            return at if batch is None else self._note(at, batch)
        return self._write(made.changes, at, steps, now, batch, self.strategies, self.null_desired, since, rebase)

    def _base_of(self, made: Plan, at: Version) -> Version | None:
        """The version the plan was made against, if it is kept and still part of the history."""
        if made.meta.seq is None or made.meta.lineage != at.lineage or made.meta.seq > at.seq:
            return None
        base = self.log.load(made.meta.seq)
        fits = base is not None and (base.serial, base.digest, base.schema) == (made.meta.serial, made.meta.digest, at.schema)
        return base if fits else None

    def _check(self, changes: DataFrame, at: Version) -> DataFrame:
        todo = changes.filter(F.coalesce(F.col("action") != "no-op", F.lit(True)))
        touched = [r[0] for r in todo.select(self._part(at.modulus, at.split)).distinct().collect()]
        return check_plan(changes, self._read(at, touched), self.keys)

    def _note(self, at: Version, batch: str) -> Version:
        """A version that only says that a batch is done."""
        while True:
            made = replace(at, seq=at.seq + 1, batch=batch, streams=_with_batch(at.streams, batch), put=[], created=_now())
            if self.log.add(made):
                return made
            at = self.require()

    def _stored(self, made: Plan) -> Plan:
        """The plan's actionable rows, written once: checks, counts and the new
        version then read them instead of joining both tables again."""
        if made.stored:
            return made
        path = scratch_path(self.spark, "plan")
        save_plan(made, path)
        return load_plan(self.spark, path)

    def _write(
        self,
        changes: DataFrame,
        at: Version,
        steps: int,
        now: Column | datetime | None,
        batch: str | None,
        strategies: Mapping[str, str],
        null_desired: str,
        since: Version | None = None,
        rebase: bool = False,
    ) -> Version:
        """The next version: delta rows for the parts it touches, and parts written anew where
        deltas have grown or a part is split.

        ``changes`` may bear ``MARKS``; then no-ops are written too, for their marks.
        """
        stored = T.StructType.fromJson(json.loads(at.schema))
        marked = MARKS in changes.columns
        marks = [f for f in stored.fields if f.name == MARKS] or ([changes.schema[MARKS]] if marked else [])
        visible = T.StructType([f for f in stored.fields if f.name != MARKS])
        now = moment(now)
        streams = _with_batch(at.streams, batch)
        more = {"lineage": at.lineage, "serial": at.serial + steps, "seq": at.seq + 1, "batch": batch, "streams": streams}
        planned = "planned" in changes.columns
        after = snapshot_schema(self.spark.createDataFrame([], visible), changes) if planned else visible
        if after.simpleString() != visible.simpleString():
            # New columns, or new fields inside one, change every row and its hash.
            whole = apply_changes(self.read(at), changes, self.keys, now, strategies, null_desired)
            if marks:
                whole = self._with_marks(whole, at, None, changes if marked else None, marks[0])
            made = self._from_rows(whole, at.modulus, at.split, at, **more)
            return self._land(made, set(made.put), steps, since or at, False)

        actions = ("create", "update", "no-op") if marked else ("create", "update")
        kept_marks = [MARKS] if marked else []
        if planned:
            of = changes.filter(F.col("action").isin(*actions))
            put = of.select(*next_columns(of, self.keys, visible, now, strategies, null_desired), *kept_marks)
        else:
            put = self.spark.createDataFrame([], T.StructType([*visible.fields, *(marks if marked else [])]))
        rest = [F.col("prior")[c].alias(c) for c in visible.names if c not in self.keys]
        leave = ("update", "delete", "no-op") if marked else ("update", "delete")
        gone = changes.filter(F.col("action").isin(*leave)).select(*self.keys, *rest).select(*visible.names)
        moves = self._moves([(1, put.drop(MARKS)), (-1, gone)], at.modulus, at.split)

        rows = at.rows + sum(s[0] for s in moves.parts.values())
        modulus, split, splits = grown(at.modulus, at.split, rows, self.part_rows)
        parts = at.numbered()
        heavy = {p for p, _ in splits if p in parts or p in moves.parts}
        for p in set(moves.parts) - heavy:
            had = parts.get(p) or _new_part(p, None)
            if len(had["deltas"]) >= MOST_DELTAS or had["delta_rows"] + moves.gross[p] > self.share * had["rows"]:
                heavy.add(p)
        light = set(moves.parts) - heavy
        if marks and not marked:
            put = self._with_marks(put, at, set(moves.parts), None, marks[0])
        names = [*visible.names, *[f.name for f in marks]]
        none = {MARKS: F.lit(None).cast(marks[0].dataType)} if marks else {}
        put = put.withColumns(none).select(*names) if marks and MARKS not in put.columns else put.select(*names)
        writing = F.lit(at.seq + 1).cast("long")
        old_part = self._part(at.modulus, at.split)
        frames = []
        if light:
            inside = old_part.isin(*light)
            dead = changes.filter((F.col("action") == "delete") & inside).select(*self.keys)
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in [*visible.fields, *marks] if f.name not in self.keys]
            dead = dead.select(*self.keys, *nulls).select(*names, writing.alias(_WRITE), F.lit(True).alias(_GONE))
            frames.append(put.filter(inside).select(*names, writing.alias(_WRITE), F.lit(False).alias(_GONE)))
            frames.append(dead)
        if heavy:
            prior = self._read(at, heavy)
            prior = prior.withColumns(none) if marks and MARKS not in prior.columns else prior
            touched = changes.select(*self.keys)
            base = prior.join(touched, self.keys, "left_anti").select(*names)
            base = base.unionByName(put.filter(old_part.isin(*heavy)))
            frames.append(base.select("*", F.lit(None).cast("long").alias(_WRITE), F.lit(None).cast("boolean").alias(_GONE)))
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        data = self._store(every, modulus, split)
        wrote = {int(n.split("=")[1]) for n in self.log.names(data) if n.startswith(f"{_PART}=")}

        for p in light:
            had = parts.get(p) or _new_part(p, None)
            parts[p] = had | {
                "rows": had["rows"] + moves.parts[p][0],
                "deltas": [*had["deltas"], f"{data}/{_PART}={p}"],
                "delta_rows": had["delta_rows"] + moves.gross[p],
                "sums": _plus(had["sums"], moves.parts[p]),
            }
        anew = {p: (parts.get(p) or _new_part(p, None)) for p in heavy}
        for p, had in anew.items():
            sums = _plus(had["sums"], moves.parts.get(p, _ZERO))
            parts[p] = _new_part(p, f"{data}/{_PART}={p}" if p in wrote else None) | {"sums": sums, "rows": sums[0]}
        if splits:
            # both halves of a split part: their sums are those of the rows just written
            halves = {h for p, step in splits for h in (p, p + step)}
            fresh = [_new_part(h, f"{data}/{_PART}={h}" if h in wrote else None) for h in sorted(halves)]
            parts |= {p["part"]: p for p in fresh}
            whole = T.StructType([*visible.fields, *marks])
            halved = replace(at, parts=[p for p in fresh if p["path"]], schema=whole.json())
            found = self._moves([(1, self._read(halved))], modulus, split) if halved.parts else Moves({}, {}, {})
            for p in fresh:
                p["sums"] = found.parts.get(p["part"], list(_ZERO))
                p["rows"] = p["sums"][0]
            heavy |= halves
        made = replace(
            at,
            schema=T.StructType([*visible.fields, *marks]).json(),
            modulus=modulus,
            split=split,
            parts=[parts[i] for i in sorted(parts)],
            sums=_shifted(at.sums, moves.buckets),
            rows=rows,
            put=sorted(light | heavy),
            **more,
        )
        if since is not None and since.seq < at.seq:
            met = self.log.put_since(since.seq, at.seq) & (light | heavy)
            if met:
                raise StalePlanError("serial changed; plan again")
        return self._land(made, light | heavy, steps, at, rebase)

    def _with_marks(
        self, rows: DataFrame, at: Version, only: Collection[int] | None, changes: DataFrame | None, field: T.StructField
    ) -> DataFrame:
        """``rows`` with the marks their keys have, the ones in ``changes`` first."""
        schema = T.StructType.fromJson(json.loads(at.schema))
        sides = [s for s in (changes, self._read(at, only) if MARKS in schema.names else None) if s is not None]
        marks = []
        for i, side in enumerate(sides):
            own = side.select(*[F.col(k).alias(f"__k{i}_{k}") for k in self.keys], F.col(MARKS).alias(f"__m{i}"))
            rows = rows.join(own, [F.col(k) == F.col(f"__k{i}_{k}") for k in self.keys], "left")
            marks.append(F.col(f"__m{i}"))
        value = F.coalesce(*marks) if marks else F.lit(None).cast(field.dataType)
        gone = [f"__m{i}" for i in range(len(sides))] + [f"__k{i}_{k}" for i in range(len(sides)) for k in self.keys]
        return rows.withColumn(MARKS, value.cast(field.dataType)).drop(*gone)

    # Streams.

    def done(self, batch: str) -> bool:
        """Whether a streamed batch was applied before."""
        at = self.current()
        name, number = _batch_number(batch)
        return at is not None and at.streams.get(name, -1) >= number

    def upsert(
        self, rows: DataFrame, order: str, now: Column | datetime | None = None, batch: str | None = None
    ) -> Version:
        """Lay rows over the table, each value where its ``order`` is the highest yet.

        The table keeps, per key and column, the order of the value it holds, so rows may come
        in any batches and in any sequence: the table is the same.  Of equal orders the larger
        value counts.  A null value says nothing unless the store's ``null_desired`` is
        ``value``; maps, structs and JSON count as one value.  A null order comes before all others.
        """
        at = self.require()
        stored = T.StructType.fromJson(json.loads(at.schema))
        own = [c for c in rows.columns if c not in (*self.keys, order)]
        newest = materialize(reduced(rows, self.keys, order, own, self.null_desired), "batch")
        touched = [r[0] for r in newest.select(self._part(at.modulus, at.split)).distinct().collect()]
        prior = self._read(at, touched).join(newest.select(*self.keys), self.keys, "left_semi")
        known = {f.name for f in stored[MARKS].dataType.fields} if MARKS in stored.names else set()
        rest = [c for c in stored.names if c not in (*self.keys, MARKS)]
        side = prior.select(
            *[F.col(k).alias(f"__k_{k}") for k in self.keys],
            F.struct(*[F.col(c) for c in rest or self.keys]).alias("__prior"),
            *([F.col(MARKS).alias("__pm")] if known else []),
        )
        both = newest.join(side, [F.col(k) == F.col(f"__k_{k}") for k in self.keys], "left")
        held = F.col("__prior").isNotNull()
        types = {c: rows.schema[c].dataType for c in own}
        order_type = rows.schema[order].dataType
        values, marks, hits, moved = [], [], [], [F.lit(False)]
        for c in own:
            mine, value = F.col(f"{c}.mark"), F.col(f"{c}.value")
            mark = F.col("__pm")[c].cast(order_type) if c in known else F.lit(None).cast(order_type)
            have = F.col("__prior")[c] if c in rest else F.lit(None).cast(types[c])
            had = stored[c].dataType if c in rest else types[c]
            larger = comparable(value, types[c]) > comparable(conform(have, had, types[c]), types[c])
            tie = (mine == mark) & ((have.isNull() & value.isNotNull()) | F.coalesce(larger, F.lit(False)))
            later = ~held | mark.isNull() | (mine > mark) | tie
            take = F.coalesce(F.col(f"{c}.seen") & later, F.lit(False))
            after = F.when(take, value).otherwise(conform(have, had, types[c]))
            values.append(after.alias(c))
            marks.append(F.when(take, mine).otherwise(mark).alias(c))
            hits.append(take & differs(value, have, types[c], had, "exact"))
            moved.append(take & (mark.isNull() | (mine != mark)))
        more = [F.col("__pm")[c].alias(c) for c in sorted(known - set(own))]
        no_key = any_of([F.col(k).isNull() for k in self.keys])
        refused = F.raise_error(F.lit("a key is null")).cast("string")
        action = F.when(no_key, refused).when(~held, "create").when(any_of(hits), "update").otherwise("no-op")
        planned = F.struct(*values) if values else F.struct(*[F.col(k) for k in self.keys])
        kept_marks = [F.struct(*marks, *more).alias(MARKS)] if marks or more else []
        changes = both.select(
            *self.keys, action.alias("action"), planned.alias("planned"), F.col("__prior").alias("prior"), *kept_marks,
            any_of(moved).alias("__moved"),
        )
        seen = Observation()
        counts = [F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ACTIONS]
        changes = changes.filter((F.col("action") != "no-op") | F.col("__moved")).drop("__moved")
        changes = materialize(changes.observe(seen, *counts), "upsert")
        made = seen.get
        if not sum(made.values()):
            return at if batch is None else self._note(at, batch)
        steps = sum(made[a] for a in ACTIONABLE)
        return self._write(changes, at, steps, now, batch, dict.fromkeys(own, "exact"), "value", rebase=True)

    # Live tables.

    def differing_parts(self, live: DataFrame, at: Version | None = None) -> set[int]:
        """The parts whose rows' hashes do not add up to what the version holds.

        One pass over ``live``, one row per part; nothing is joined.  ``live`` must have the
        table's columns, in any order; timestamps do not count.
        """
        at = at or self.require()
        schema = T.StructType.fromJson(json.loads(at.schema))
        columns = [c for c in schema.names if c not in (*TIMESTAMPS, MARKS)]
        view = live.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])
        found = self._moves([(1, view)], at.modulus, at.split).parts
        have = {p["part"]: p["sums"] for p in at.parts}
        return {p for p in {*found, *have} if list(found.get(p, _ZERO)) != list(have.get(p, _ZERO))}

    def drift(self, live: DataFrame, echo: Sequence[str] = ()) -> DataFrame:
        """``drift`` of the table against ``live``, read from the parts that differ only."""
        at = self.require()
        return self._drift(at, live, echo, whole_prior=False)

    def _drift(self, at: Version, live: DataFrame, echo: Sequence[str], whole_prior: bool) -> DataFrame:
        state = self.read(at)
        own = [c for c in state.columns if c not in (*self.keys, *TIMESTAMPS, *echo)]
        exclude = [*TIMESTAMPS, *echo]
        same = not echo and {c for c in live.columns if c not in TIMESTAMPS} == {*self.keys, *own}
        same = same and all(live.schema[c].dataType == state.schema[c].dataType for c in (*self.keys, *own))
        if same:
            parts = self.differing_parts(live, at)
            if not parts:
                nothing = self.spark.createDataFrame([], state.schema)
                return drift(nothing, nothing.drop(*TIMESTAMPS), self.keys, exclude, whole_prior)
            state = self._read(at, parts).drop(MARKS)
            if len(parts) < len(at.parts):
                live = live.filter(self._part(at.modulus, at.split).isin(*parts))
        # A column the live table lost is null there.
        lost = {c: F.lit(None).cast(state.schema[c].dataType) for c in own if c not in live.columns}
        return drift(state, live.withColumns(lost), self.keys, exclude, whole_prior)

    def refresh(
        self, live: DataFrame, now: Column | datetime | None = None, echo: Sequence[str] = ()
    ) -> tuple[Version, bool]:
        """Bring the table up to ``live``; one serial step if anything changed.

        Parts whose hash sums agree are not read.  One join finds the drift of the others,
        which is written; only its rows are written anew.  The rows are those of ``drift.refresh``.
        """
        at = self.require()
        changes = materialize(self._drift(at, live, echo, whole_prior=True).drop("changed_fields"), "drift")
        if changes.isEmpty():
            return at, False
        own = [c for c in self.read(at).columns if c not in (*self.keys, *TIMESTAMPS, *echo)]
        return self._write(changes, at, 1, now, None, dict.fromkeys(own, "exact"), "value"), True

    # History.

    def sweep(self, keep: int = 10, grace_seconds: float = 86_400) -> list[str]:
        """Remove data that none of the last ``keep`` versions names, and log entries that no kept
        version needs.  Data younger than ``grace_seconds`` stays: a writer may be about to name it.
        Returns the removed paths.
        """
        if keep < 1:
            raise ValueError("the current version is always kept")
        seqs = self.log.seqs()
        if not seqs:
            return []
        kept = [self.version(s) for s in seqs[-keep:]]
        named = {path for v in kept for p in v.parts for path in [p["path"], *p["deltas"]] if path}
        tails = {"/".join(path.split("/")[-2:]) for path in named}
        gone = []
        for folder in self.log.names(f"{self.path}/data"):
            inside = [n for n in self.log.names(f"{self.path}/data/{folder}") if n.startswith(f"{_PART}=")]
            dead = [n for n in inside if f"{folder}/{n}" not in tails]
            if not dead and inside or self.log.age(f"{self.path}/data/{folder}") < grace_seconds:
                continue
            paths = [f"{self.path}/data/{folder}"] if len(dead) == len(inside) else [f"{self.path}/data/{folder}/{n}" for n in dead]
            for path in paths:
                self.log.remove(path)
            gone += paths
        first = kept[0].seq - kept[0].seq % WHOLE_EVERY
        for seq in seqs:
            if seq < first:
                path = self.log._file(seq)
                self.log.remove(path)
                gone.append(path)
        return gone
