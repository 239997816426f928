"""Main text of web pages by differencing each page with its nearest neighbour.

Pages of one host are ordered by URL path; a page's neighbours are the nearest ones
before and after it whose URL and lines both differ from its own, and its mate is the
neighbour whose URL begins most like its own.  The lines of both are aligned by their
longest common subsequence, and shared lines go: a site's template repeats, the
article does not.  Markup says where to look: menus, headers, footers, forms, adverts
and reader comments always go, and where a page states an article, only lines inside
it may be main text.  Shared lines go inside it too, unless the mate is a copy: a mate
that shares most of an article's characters, or nearly all of what may be main text
where no article is marked, gives way to the other neighbour or else takes nothing away.

The order is a range partitioning of all pages, so a large host is spread over many
tasks.  Every range also gets the few pages before and after it that may be neighbours
of its own, however many equal pages or ranges lie between, so that every page sees
both neighbours whatever the number of ranges.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, prepare, shuffle_partitions, text_column
from tablerecon.llm.html_text import OPEN, STATED, WRAPPED, Block, blocks, common_lines

PAGES_PER_RANGE = 2_000
SAMPLED_PER_RANGE = 40

# Per cent of the characters that may be main text; a mate that shares more is a copy.
COPY_OF_ARTICLE = 50
COPY_OF_PAGE = 90

_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?")


def place_of(url: str | None) -> tuple[str, str]:
    """Host, and path with query; a text that is no URL has no host."""
    found = _URL.match(url or "")
    if not found:
        return "", url or ""
    return found[1].lower(), (found[2] or "/") + (found[3] or "")


def order_key(url: str | None, page_id: object) -> str:
    host, path = place_of(url)
    number = f"{page_id:+021d}" if isinstance(page_id, int) else str(page_id)
    return "\x1f".join((host, path, url or "", number))


def likeness(a: str, b: str) -> int:
    """Characters that two paths begin with alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _line_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Mark(NamedTuple):
    """A page's place in the order, and what must differ in a neighbour."""

    key: str
    host: str
    url: str | None
    same: str  # digest of the lines


def _mark(url: str | None, page_id: object, same: str) -> _Mark:
    return _Mark(f"{order_key(url, page_id)}\x1f{same}", place_of(url)[0], url, same)


def _unlike(held: list[_Mark], url: str | None = None, same: str | None = None) -> _Mark | None:
    """The first of ``held`` whose URL and lines both differ; None does not count."""
    return next((m for m in held if m.url != url and m.same != same), None)


def _with(held: list[_Mark], m: _Mark) -> list[_Mark]:
    """What is left of ``held`` after a further page: those that may still be the nearest
    one unlike some later page, nearest first.  Five are enough: the page itself, for later
    ones with its URL the nearest with another URL, then the nearest whose lines differ from
    that one's as well; and the same with URL and lines exchanged."""
    if not m.host:
        return held
    near = [m, *(held if held and held[0].host == m.host else [])]
    a, b = _unlike(near, url=m.url), _unlike(near, same=m.same)
    kept = [m, a, a and _unlike(near, m.url, a.same), b, b and _unlike(near, b.url, m.same)]
    return [x for x in near if any(x is k for k in kept)]


def _edges(marks: Iterable[_Mark]) -> list[_Mark]:
    """Those of a range's pages that may be neighbours of pages before or after it, in order."""
    row = sorted(set(marks))
    up: list[_Mark] = []
    down: list[_Mark] = []
    for m, n in zip(row, reversed(row), strict=True):
        up, down = _with(up, m), _with(down, n)
    return sorted({*up, *down})


def _neighbours(row: list[_Mark]) -> list[_Mark | None]:
    """The nearest page before each one that is of its host and unlike it."""
    held: list[_Mark] = []
    out: list[_Mark | None] = []
    for m in row:
        out.append(_unlike(held, m.url, m.same) if held and held[0].host == m.host else None)
        held = _with(held, m)
    return out


@dataclass
class _Page:
    path: str
    hashes: list[int]
    kept: list[tuple[int, str]]  # index of the line, and its text
    article: bool


def _same(found: list[Block]) -> str:
    return blake2b("\n".join(b.text for b in found).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _parse(found: list[Block]) -> tuple[list[int], list[tuple[int, str]], bool]:
    """Hashes of all lines, the lines that may be main text, and whether an <article> holds some of them."""
    wanted = next((k for k in (STATED, OPEN, WRAPPED) if any(b.kind == k for b in found)), OPEN)
    lines = [(i, b.text) for i, b in enumerate(found) if b.kind == wanted]
    return [_line_hash(b.text) for b in found], lines, any(b.article and b.kind == wanted for b in found)


def _is_copy(page: _Page, shared: list[bool]) -> bool:
    most = COPY_OF_ARTICLE if page.article else COPY_OF_PAGE
    both = sum(len(t) for i, t in page.kept if shared[i])
    return 100 * both > most * sum(len(t) for _, t in page.kept)


def _main_text(page: _Page, mates: list[_Page]) -> str:
    gone: list[bool] | None = None
    for mate in sorted(mates, key=lambda m: -likeness(page.path, m.path)):  # the earlier one of equals first
        shared = common_lines(page.hashes, mate.hashes)
        if not _is_copy(page, shared):
            gone = shared
            break
    return "\n\n".join(t for i, t in page.kept if gone is None or not gone[i])


def _ranges(pages: DataFrame, count: int) -> tuple[list[str], dict[str, list[int]]]:
    """Split points of about equal ranges, and keys with the further ranges that must see them."""
    spark = pages.sparkSession
    n = max(1, math.ceil(count / PAGES_PER_RANGE), min(shuffle_partitions(spark), count // 50))
    if n > 1:
        # decides the borders only; results do not depend on them
        rows = pages.select("page_id", "url").sample(min(1.0, n * SAMPLED_PER_RANGE / count), 7).collect()
        sample = sorted(order_key(r["url"], r["page_id"]) for r in rows)
        splits = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    else:
        splits = []
    if not splits:
        return splits, {}

    def shortened(marks: Iterable[tuple[int, _Mark]]) -> pa.RecordBatch:
        held: dict[int, list[_Mark]] = {}
        for r, m in marks:
            row = held.setdefault(r, [])
            row.append(m)
            if len(row) == 200:
                held[r] = _edges(row)
        rows = [(r, m.key, m.url, m.same) for r, row in held.items() for m in _edges(row)]
        cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], ["r", "key", "url", "same"]
        )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, _Mark]]:
            for batch in batches:
                ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
                for i, url, page in zip(ids, urls, text_column(batch, "html"), strict=True):
                    if place_of(url)[0]:
                        m = _mark(url, i, _same(blocks(page)))
                        yield bisect_right(splits, m.key), m

        yield shortened(each())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, _Mark]]:
            for batch in batches:
                for r, key, url, same in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                    yield r, _Mark(key, place_of(url)[0], url, same)

        yield shortened(each())

    schema = "r int, key string, url string, same string"
    found: dict[int, list[_Mark]] = {}
    for x in mapped(mapped(pages, first, schema).repartition(len(splits) + 1, "r"), again, schema).collect():
        found.setdefault(x["r"], []).append(_Mark(x["key"], place_of(x["url"])[0], x["url"], x["same"]))
    also: dict[str, list[int]] = {}
    for down in (False, True):
        held: list[_Mark] = []
        for r in sorted(found, reverse=down):
            row = sorted(found[r], reverse=down)
            if held and held[0].host == row[0].host:
                for m in held:
                    also.setdefault(m.key, []).append(r)
            for m in row:
                held = _with(held, m)
    return splits, also


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text)``, one row per input row; blocks are joined by a blank line.

    A null or empty page has an empty text.  A null URL, or one without host, has no
    mate; neither has a page whose host has none but pages with the very same URL or the
    very same lines (copies of one page, not two pages).  Null and repeated ids keep their rows; an
    empty table gives an empty result; other columns are ignored.
    """
    import zstandard

    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    splits, also = _ranges(rows, rows.count())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        sent: set[tuple[int, str]] = set()
        for batch in batches:
            take, range_no, keys, halo, blobs = [], [], [], [], []
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for i, page in enumerate(text_column(batch, "html")):
                found = blocks(page)
                blob = pack(json.dumps(_parse(found)).encode())
                key = _mark(urls[i], ids[i], _same(found)).key
                own = bisect_right(splits, key)
                more = [r for r in also.get(key, ()) if (r, key) not in sent]
                sent.update((r, key) for r in more)
                for r in (own, *more):
                    take.append(i)
                    range_no.append(r)
                    keys.append(key)
                    halo.append(r != own)
                    blobs.append(blob)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array(range_no, pa.int32()),
                    "key": pa.array(keys, pa.string()),
                    "halo": pa.array(halo, pa.bool_()),
                    "page_id": batch.column("page_id").take(at),
                    "url": batch.column("url").take(at),
                    "lines": pa.array(blobs, pa.binary()),
                }
            )

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        @lru_cache(16)
        def page_of(url: str | None, blob: bytes) -> _Page:
            return _Page(place_of(url)[1], *json.loads(unpack(blob)))

        def ranges() -> Iterator[list[tuple]]:
            now, row = None, []
            once: dict[bytes, bytes] = {}  # copies of a page are held once
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("range", "key", "halo", "page_id", "url", "lines")]
                for r, *rest, lines in zip(*cols, strict=True):
                    if r != now:
                        yield row
                        now, row, once = r, [], {}
                    row.append((*rest, once.setdefault(lines, lines)))
            yield row

        def texts() -> Iterator[tuple[object, str | None, str]]:
            for row in ranges():
                marks = [_Mark(key, place_of(url)[0], url, key[-16:]) for key, _, _, url, _ in row]
                lines_of = {key: lines for key, _, _, _, lines in row}
                before, after = _neighbours(marks), _neighbours(marks[::-1])[::-1]
                for (_, halo, page_id, url, lines), *near in zip(row, before, after, strict=True):
                    if not halo:
                        mates = [page_of(m.url, lines_of[m.key]) for m in near if m]
                        yield page_id, url, _main_text(page_of(url, lines), mates)

        held: list[tuple] = []
        for row in texts():
            held.append(row)
            if len(held) == 500:
                yield out(held)
                held = []
        if held:
            yield out(held)

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def out(held: list[tuple]) -> pa.RecordBatch:
        ids, urls, found = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict(
            {"page_id": pa.array(ids, id_type), "url": pa.array(urls, pa.string()), "text": pa.array(found, pa.string())}
        )

    sent = mapped(rows, parse, f"`range` int, key string, halo boolean, page_id {kind}, url string, lines binary")
    laid = sent.repartition(len(splits) + 1, "range").sortWithinPartitions("range", "key", "halo")
    return mapped(laid, difference, f"page_id {kind}, url string, text string")
