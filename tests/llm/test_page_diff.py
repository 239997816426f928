import random

import pytest
from pyspark.sql import types as T
from tablerecon.llm.html_text import OPEN, SIDE, STATED, blocks, common_lines
from tablerecon.llm.page_diff import _edges, _mark, _neighbours, _with, extract_main_text, likeness, order_key, place_of

PAGE = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


@pytest.fixture
def make_pages(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, PAGE).repartition(parts)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(12))]
        kept = [x for x, s in zip(a, common_lines(a, b), strict=True) if s]
        assert len(kept) == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in kept)


def texts(page):
    return [(b.text, b.kind) for b in blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain  text", [("plain text", OPEN)]),
        ("<article><h1>T</h1><p>a&amp;b&nbsp;c<p>d<br>e</article>", [("T", STATED), ("a&b c", STATED), ("d e", STATED)]),
        ("<nav><a>x</a></nav><main>m</main><footer>f", [("x", SIDE), ("m", STATED), ("f", SIDE)]),
        ("<div class='ad box'>buy</div><div>keep</div>", [("buy", SIDE), ("keep", OPEN)]),
        ("<article><p>a<section class=comments><p>c</section><p>b</article>", [("a", STATED), ("c", SIDE), ("b", STATED)]),
        ('<script>var t="</p>";</script><style>p{}</style>a<!-- <p>no --> b', [("a b", OPEN)]),
        ("<p>cut off &am", [("cut off &am", OPEN)]),
        ("<p>cut <a hre", [("cut", OPEN)]),
        ("a < b", [("a < b", OPEN)]),
        ("<article><p><b>open<br><p>next</p></article><p>out", [("open", STATED), ("next", STATED), ("out", OPEN)]),
        ("<article><header><h1>head</h1></header><p>x</p><form><p>name</form></article>", [("head", STATED), ("x", STATED), ("name", SIDE)]),
        ("<title>t</title><p title='a>b'>x&#233;&eacute;</p>", [("xéé", OPEN)]),
        ("<p>one <em>two</em>, <span>three</span></p>", [("one two, three", OPEN)]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_urls():
    assert place_of("https://A.example.com/x/y?q=1#top") == ("a.example.com", "/x/y?q=1")
    assert place_of("//h") == ("h", "/") and place_of(None) == ("", "") and place_of("no url") == ("", "no url")
    assert likeness("/a/b", "/a/c") == 3
    assert order_key("http://h/a", 2) < order_key("http://h/a", 10) < order_key("http://h/b", 1)


def site(host, n, rng):
    """Pages of one template, without an article element."""
    top, end = f"<div>Welcome to {host}</div><div>Home | About</div>", "<div>All rights reserved</div>"
    out = []
    for i in range(n):
        body = [f"{host} story {i} line {k} {rng.random()}" for k in range(rng.randint(1, 6))]
        out.append((f"http://{host}/{i:03d}", top + "".join(f"<p>{x}</p>" for x in body) + end, "\n\n".join(body)))
    return out


@pytest.mark.parametrize("per_range", [5, 2_000])
def test_template_lines_go(make_pages, monkeypatch, per_range):
    monkeypatch.setattr("tablerecon.llm.page_diff.PAGES_PER_RANGE", per_range)
    rng = random.Random(3)
    rows = [p for host, n in (("hot.example", 60), ("b.example", 7), ("c.example", 2)) for p in site(host, n, rng)]
    pages = make_pages([(i, url, page) for i, (url, page, _) in enumerate(rows)], 4)
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_stated_articles_stay_even_when_copied(make_pages):
    page = "<body><div>Site</div><article><p>same text</p></article><footer>f</footer>"
    got = extract_main_text(make_pages([(1, "http://h/a", page), (2, "http://h/b", page)])).collect()
    assert [r["text"] for r in got] == ["same text"] * 2


@pytest.mark.parametrize("element", ["article", "main"])
def test_notices_inside_stated_blocks_go(make_pages, element):
    rows, want = [], {}
    for i in range(6):
        body = [f"Story {i} has line {k} of its own, which no other page holds." for k in range(1 + i % 3)]
        notice = "<p>Read more of this by mail.</p>"
        rows.append((i, f"http://h/{i}", f"<{element}>{notice}" + "".join(f"<p>{x}</p>" for x in body) + f"{notice}</{element}>"))
        want[i] = "\n\n".join(body)
    assert {r["page_id"]: r["text"] for r in extract_main_text(make_pages(rows)).collect()} == want


def test_main_that_wraps_the_page_is_differenced(make_pages):
    rows = [(i, url, f"<main>{page}</main>") for i, (url, page, _) in enumerate(site("m.example", 20, random.Random(4)))]
    want = {i: text for i, (_, _, text) in enumerate(site("m.example", 20, random.Random(4)))}
    assert {r["page_id"]: r["text"] for r in extract_main_text(make_pages(rows)).collect()} == want


def test_neighbours_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        urls = [f"http://{rng.choice('gh')}/{rng.randrange(4)}" for _ in range(rng.randrange(25))]
        row = sorted(_mark(u, i, f"{rng.randrange(3):016x}") for i, u in enumerate(urls))
        want = [
            next((x for x in row[:i][::-1] if x.host == m.host and x.url != m.url and x.same != m.same), None)
            for i, m in enumerate(row)
        ]
        assert _neighbours(row) == want
        # what a range passes on answers for all of it, put together from parts in any order
        cut = rng.randrange(len(row) + 1)
        early = _edges([*_edges(row[:cut:2]), *_edges(row[1:cut:2])])
        assert len(early) <= 10
        assert _neighbours(early + row[cut:])[len(early) :] == want[cut:]
        held = []
        for m in row:
            held = _with(held, m)
            assert len(held) <= 5


@pytest.mark.parametrize("per_range", [3, 2_000])
@pytest.mark.parametrize("copies", [1, 3, 40])
def test_copies_are_no_mates(make_pages, monkeypatch, per_range, copies):
    monkeypatch.setattr("tablerecon.llm.page_diff.PAGES_PER_RANGE", per_range)
    rows = [p for host, n in (("h.example", 6), ("i.example", 5)) for p in site(host, n, random.Random(8))]
    # some pages stand under a second URL as well, and pages stand there several times
    rows += [(f"{url}?utm_source=feed", page, want) for url, page, want in rows[1::2]]
    rows = [r for i, r in enumerate(rows) for _ in range(copies if i % 3 else 1)]
    pages = make_pages([(i, url, page) for i, (url, page, _) in enumerate(rows)], 4)
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_a_mate_with_nearly_all_lines_gives_way(make_pages):
    story = [f"A long line of the story with its number {i} and some more words." for i in range(20)]
    page = lambda *x: "".join(f"<p>{t}</p>" for t in ("Site", *x, "The end"))
    rows = [
        (1, "http://h/a/1", page(*story, "seen 1 time")),
        (2, "http://h/a/1?x", page(*story, "seen 2 times")),
        (3, "http://h/b", page("Something else.")),
        (4, "http://two/a", page(*story, "seen 1 time")),
        (5, "http://two/a?x", page(*story, "seen 2 times")),
    ]
    got = {r["page_id"]: r["text"].split("\n\n") for r in extract_main_text(make_pages(rows)).collect()}
    assert got[2] == [*story, "seen 2 times"] and got[3] == ["Something else."]
    # no other page to tell the template from the story
    assert got[4] == ["Site", *story, "seen 1 time", "The end"] and got[5][1:-2] == story


def test_awkward_rows(make_pages, spark):
    rows = [
        (1, None, "<p>a</p>"),
        (1, None, "<p>a</p>"),
        (None, "http://h/x", "<p>b</p>"),
        (2, "http://h/x", None),
        (3, "http://h/x", ""),
        (4, "http://h/y", "<p>" + "long " * 100_000),
        (5, "http://alone/", "<p>c</p>"),
        (6, "nonsense", "<p>d</p>"),
        (7, "http://h/x", "<p>b</p>"),
    ]
    want = [(i, u, " ".join((h or "")[3:].replace("</p>", "").split())) for i, u, h in rows]
    from pyspark.sql import functions as F

    for df in (make_pages(rows), make_pages(rows).select("*", F.lit(1).alias("range"), F.lit("k").alias("key"), F.lit("t").alias("text"))):
        got = [tuple(r) for r in extract_main_text(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert extract_main_text(spark.createDataFrame([], PAGE)).collect() == []


def _kept(page):
    from tablerecon.llm.page_diff import _parse

    return [t for _, t in _parse(blocks(page))[1]]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>One</p><svg class='i' viewBox='0 0 1 1' /><p>Two</p></article>", ["One", "Two"]),
        ("<article><p>One</p><svg><path d='x'/><text>no</text></svg><p>Two</p></article>", ["One", "Two"]),
        ("<div class='layout has-sidebar'><article><p>One</p></article></div>", ["One"]),
        ("<div id='search-page'><main><p>One</p></main></div>", ["One"]),
        ("<form id='aspnetForm'><nav>no</nav><article><p>One</p></article></form>", ["One"]),
        ("<form id='aspnetForm'><p>One</p></form>", ["One"]),
        ("<body><form><p>no</p></form><p>One</p></body>", ["One"]),
        ("<article><p class='ad'>buy<p>Real para</article>", ["Real para"]),
        ("<article><p class='social-science'>One</p><div class='entry-header'><h1>Head</h1></div></article>", ["One", "Head"]),
        ("<article><p>One</p><div class='ad-slot'>no</div><div class='related-posts'>no</div></article>", ["One"]),
        ("<article><ul><li class='share'>no<li>One<li>Two</ul><table><tr><td class='ad'>no<td>Cell</table></article>", ["One", "Two", "Cell"]),
        ("<div class='related'><article>no</article></div><article><p>One</p></article>", ["One"]),
        ("<article><p>One<hr>Two</article>", ["One", "Two"]),
    ],
)
def test_articles_are_not_lost(page, want):
    assert _kept(page) == want


def test_long_pages_align_in_bounded_memory(monkeypatch):
    import random
    import tracemalloc

    from tablerecon.llm import html_text as H

    rnd = random.Random(4)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    for bits, pairs, block in ((40, 1 << 20, 4096), (4, 0, 7), (4, 5, 3)):
        monkeypatch.setattr(H, "_MOST_BITS", bits)
        monkeypatch.setattr(H, "_MOST_PAIRS", pairs)
        monkeypatch.setattr(H, "_BLOCK", block)
        for _ in range(80):
            a, b = ([rnd.randrange(1, 6) for _ in range(rnd.randrange(30))] for _ in range(2))
            got = [x for x, both in zip(a, common_lines(a, b), strict=True) if both]
            rest = iter(b)
            assert len(got) == length(a, b) and all(x in rest for x in got)
    monkeypatch.undo()
    a = [rnd.randrange(1 << 40) for _ in range(300_000)]
    b = [rnd.randrange(1 << 40) if rnd.random() < 0.01 else x for x in a]
    tracemalloc.start()
    shared = common_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert sum(shared) == sum(x == y for x, y in zip(a, b, strict=True))
