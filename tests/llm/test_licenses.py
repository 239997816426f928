import random
from collections import Counter

import pytest
from tablerecon.llm.licenses import MIN_COVERAGE, TEMPLATES, Scanner, _chains, chained, patience, scan_licenses, words_of


def test_patience_by_hand():
    assert patience(list("abcde"), list("abcde")) == [(i, i) for i in range(5)]
    # x is unique to both and anchors; the repeated a and b match only in the gaps around it
    assert patience(list("abxab"), list("axb")) == [(0, 0), (2, 1), (4, 2)]
    assert patience(list("ab"), list("cd")) == [] and patience([], list("a")) == []
    # crossing anchors: the longest increasing run stays
    assert patience(list("1234z"), list("z1234")) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_every_template_finds_itself_whole():
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"before it some words\n{text}\nand after it")
        own = [m for m in found if m.license == name]
        assert own and own[0].coverage == 1.0 and (own[0].start, own[0].end) == (4, 4 + len(words_of(text)))


def test_edits_lower_the_coverage():
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    rng = random.Random(2)
    words = words_of(TEMPLATES["MIT"])
    for share in (0.05, 0.1, 0.2):
        edited = [f"x{i}" if rng.random() < share else w for i, w in enumerate(words)]
        same = sum(a == b for a, b in zip(edited, words, strict=True)) / len(words)
        found = [m for m in scanner.scan(" ".join(edited)) if m.license == "MIT"]
        assert found and abs(found[0].coverage - same) < 0.03
    half = [f"x{i}" if i % 2 else w for i, w in enumerate(words)]
    assert not [m for m in scanner.scan(" ".join(half)) if m.license == "MIT"]


@pytest.mark.parametrize("inserted", [30, 60, 300, 20_000])
@pytest.mark.parametrize("name", ["MIT", "GPL-3.0", "BSD"])
def test_words_inside_a_notice_do_not_hide_it(name, inserted):
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    words = words_of(TEMPLATES[name])
    rng = random.Random(inserted)
    prose = [rng.choice(["the", "of", "software", "and", "copy", *(f"x{i}" for i in range(40))]) for _ in range(inserted)]
    cuts = [len(words) // 2] if name != "GPL-3.0" else [8]  # its required words stay whole
    for cut in cuts:
        text = ["before"] * 7 + words[:cut] + prose + words[cut:] + ["after"] * 50
        found = [m for m in scanner.scan(" ".join(text)) if m.license == name]
        assert len(found) == 1 and found[0].coverage >= 0.75
        assert (found[0].start, found[0].end) == (7, 7 + len(words) + inserted) or found[0].coverage < 1


def test_interrupted_notices_one_after_the_other():
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    words = words_of(TEMPLATES["MIT"])
    broken = words[:30] + [f"y{i}" for i in range(200)] + words[30:]
    apart = ["z"] * 40  # a whole notice may end in like words up to a quarter of its length behind it
    text = broken + apart + words + apart + broken
    found = [m for m in scanner.scan(" ".join(text)) if m.license == "MIT"]
    assert [(m.start, m.end) for m in found] == [
        (0, len(broken)),
        (len(broken) + 40, len(broken) + 40 + len(words)),
        (len(text) - len(broken), len(text)),
    ]
    assert all(m.coverage == 1.0 for m in found)


def test_chained_pairs_are_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(4, 14))]
        text = [w for t in template for w in (t, *(rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 0, 3]))))]
        grams = [tuple(template[k : k + 4]) for k in range(len(template) - 3)]
        seeds = [(i, grams.index(g)) for i in range(len(text) - 3) if grams.count(g := tuple(text[i : i + 4])) == 1]
        for chain in _chains(seeds):
            got = chained(text, template, chain, 0, len(text))
            assert all(text[i] == template[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_scattered_words_are_no_notice():
    rng = random.Random(4)
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    for name, template in TEMPLATES.items():
        words = [x for w in words_of(template) for x in (w, *(f"q{rng.randrange(90)}" for _ in range(40)))]
        assert not [m for m in scanner.scan(" ".join(words)) if m.license == name]


def test_notices_that_repeat():
    line = TEMPLATES["MIT line"]
    found = Scanner(TEMPLATES, MIN_COVERAGE).scan(f"{line} x {line} y " * 3)
    assert [m.license for m in found] == ["MIT line"] * 6


@pytest.mark.parametrize(
    "sibling",
    [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC 3.0.",
        "Released under the BSD License.",
        "Released under the ISC License.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the Apache License, Version 1.1.",
        TEMPLATES["Apache-2.0"].replace("2.0", "1.1"),
        TEMPLATES["GPL-3.0"].replace("version 3", "version 2"),
        " ".join(TEMPLATES["GPL-3.0"].split()).replace("GNU General", "GNU Lesser General"),
        TEMPLATES["MPL-2.0"].replace("2.0", "1.1"),
    ],
)
def test_sibling_licenses_are_not_reported(sibling):
    scanner = Scanner(TEMPLATES, MIN_COVERAGE)
    assert scanner.scan(f"some words before\n{sibling}\nand after it") == []
    # nor do they hide the notice next to them
    for name, line in TEMPLATES.items():
        if name.endswith("line"):
            for text in (f"{sibling} {line}", f"{line} {sibling}"):
                found = scanner.scan(text)
                assert {m.license.removesuffix(" line") for m in found} == {name.removesuffix(" line")}
                assert [words_of(text)[m.start : m.end] for m in found if m.license == name] == [words_of(line)]


def test_required_words_stand_in_the_template():
    with pytest.raises(ValueError, match="do not stand"):
        Scanner({"x": "some words"}, MIN_COVERAGE, {"x": ("other words",)})


def test_rows(awkward, clashing, make_docs, empty):
    docs = awkward.unionByName(make_docs([(20, f"text\n{TEMPLATES['ISC']}"), (21, "license to nothing at all")]))
    for df in (docs, clashing(docs)):
        out = scan_licenses(df).collect()
        assert len(out) == docs.count()
        assert [r["doc_id"] for r in out if r["matches"]] == [20]
    assert scan_licenses(empty).collect() == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def windows_like(words, template):
    """Starts of all windows of the template's length that share nine tenths of it in order."""
    size, have, shared = len(template), Counter(), 0
    want = Counter(template)
    for i, w in enumerate(words):
        have[w] += 1
        shared += have[w] <= want[w]
        if i >= size:
            old = words[i - size]
            shared -= have[old] <= want[old]
            have[old] -= 1
        lo = i - size + 1
        if lo >= 0 and shared >= 0.9 * size and longest_common(words[lo : i + 1], template) >= 0.9 * size:
            yield lo


def test_against_all_windows(spark, make_docs):
    """Whole texts of the documents table, and notices planted among them, window by window."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rng = random.Random(6)
    for n, (name, template) in enumerate(TEMPLATES.items()):
        words = template.split()
        near = [w for w in words if len(words) < 20 or rng.random() > 0.02]
        host = texts[rng.choice(sorted(texts))].split()
        at = rng.randrange(len(host) + 1)
        texts[1_000_000 + n] = " ".join([*host[:at], *near, *host[at:]])
    docs = make_docs([(i, t) for i, t in texts.items()])
    found = {r["doc_id"]: r["matches"] for r in scan_licenses(docs).collect()}
    scanner, seen = Scanner(TEMPLATES, MIN_COVERAGE), 0
    for i, text in texts.items():
        words = words_of(text)
        for name, template in scanner.templates.items():
            mine = [m for m in found[i] if m["license"] == name]
            for m in mine:
                common = longest_common(words[m["start"] : m["end"]], template)
                assert MIN_COVERAGE <= m["coverage"] <= common / len(template)
            for lo in windows_like(words, template):
                whole = all(
                    any(words[p : p + b - a] == template[a:b] for p in range(lo, lo + len(template) - (b - a) + 1))
                    for a, b in scanner.required[name]
                )
                if whole:
                    seen += 1
                    assert any(m["start"] < lo + len(template) and m["end"] > lo for m in mine), (i, name, lo)
    assert seen >= len(TEMPLATES) - 2
