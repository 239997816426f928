"""License scan by patience alignment of texts with license templates.

A template's rare words show where it may stand in a text; the stretch around such a
word is aligned with the template.  Words that occur once in both are anchors; the
longest increasing run of anchors is kept; the gaps between anchors are aligned in
the same way, and a gap without anchors matches word by word from both of its ends.
Where foreign words stand inside a notice, however many, runs of ``RUN`` words that the
template has once show its parts: parts in the template's order are chained, and the
gaps between them are aligned.
Coverage is the share of the template's words that were matched.  Words that tell a
license from its siblings (name, version, NC) must be matched besides, in a row and
without a word between them, since a notice of a sibling covers nearly all the rest.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import mapped, text_column

MIN_COVERAGE = 0.75
RUN = 4  # words in a row that show a part of a template

# Notices as their licenses word them.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}

# What must stand in a match whatever its coverage: CC BY 4.0, GPL version 2, Lesser and
# Affero GPL, Apache 1.1 and the like differ from the templates only here.
REQUIRED: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0",),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0",),
    "Apache-2.0 line": ("Apache License, Version 2.0",),
    "MIT line": ("the MIT License",),
    "GPL-3.0 line": ("GNU General Public License, version 3",),
    "CC-BY-NC-4.0 line": ("CC BY-NC 4.0",),
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        shared = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = _increasing(shared)
        left_a, left_b = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((left_a, i, left_b, j))
            left_a, left_b = i + 1, j + 1
        if anchors:
            todo.append((left_a, a1, left_b, b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, ordered by the first place, whose second places increase."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _place(template: list[str], row: list[str]) -> tuple[int, int]:
    for a in range(len(template) - len(row) + 1):
        if template[a : a + len(row)] == row:
            return a, a + len(row)
    raise ValueError(f"required words {' '.join(row)!r} do not stand in the template")


def _chains(seeds: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of seeds ``(text, template)`` that go forward in both; then the longest one of all."""
    run: list[tuple[int, int]] = []
    runs = 0
    for seed in seeds:
        if run and seed[1] <= run[-1][1]:
            yield run
            run, runs = [], runs + 1
        run.append(seed)
    if run:
        yield run
    if runs:
        yield _increasing(seeds)


def chained(words: list[str], template: list[str], chain: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Matched places of ``words[lo:hi]`` and the template, where the runs of ``chain`` meet."""
    out: list[tuple[int, int]] = []
    i0, j0 = lo, 0
    for i, j in chain:
        if out and i - j == out[-1][0] - out[-1][1] and i < i0:
            i, j, n = i0, j0, i + RUN - i0  # goes on where the run before it ends
        elif i < i0 or j < j0:
            continue
        else:
            n = RUN
        out += [(i0 + a, j0 + b) for a, b in patience(words[i0:i], template[j0:j])]
        out += [(i + d, j + d) for d in range(n)]
        i0, j0 = i + n, j + n
    return out + [(i0 + a, j0 + b) for a, b in patience(words[i0:hi], template[j0:])]


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int  # words of the text, end exclusive
    end: int


class Scanner:
    def __init__(
        self, templates: dict[str, str], min_coverage: float, required: dict[str, tuple[str, ...]] = REQUIRED
    ) -> None:
        self.least = min_coverage
        self.templates = {name: words_of(t) for name, t in templates.items()}
        # places of the required words in the template, begin and end of each row
        self.required = {name: [_place(t, words_of(r)) for r in required.get(name, ())] for name, t in self.templates.items()}
        often = Counter(w for t in self.templates.values() for w in set(t))
        # words that occur once in a template, the rarest and longest first; enough of them
        # that a text with the asked coverage cannot lack them all
        self.cues: dict[str, dict[str, int]] = {}
        for name, t in self.templates.items():
            once = Counter(t)
            single = sorted((w for w in once if once[w] == 1), key=lambda w: (often[w], -len(w), w))
            need = int(len(t) * (1 - min_coverage)) + 1
            self.cues[name] = {w: t.index(w) for w in (single if len(single) >= need else list(once))[:need]}
        self.any_cue = {w for cues in self.cues.values() for w in cues}
        # runs of words that stand once in a template
        self.runs: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, t in self.templates.items():
            grams = [tuple(t[k : k + RUN]) for k in range(len(t) - RUN + 1)]
            once_only = Counter(grams)
            for k, gram in enumerate(grams):
                if once_only[gram] == 1:
                    self.runs.setdefault(gram, []).append((name, k))

    def scan(self, text: str) -> list[Match]:
        words = words_of(text)
        if self.any_cue.isdisjoint(words):
            return []
        spots: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.any_cue:
                spots.setdefault(w, []).append(i)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, gram in enumerate(zip(*(words[d:] for d in range(RUN)), strict=False)):
            for name, k in self.runs.get(gram, ()):
                seeds.setdefault(name, []).append((i, k))
        found: list[Match] = []
        for name, template in self.templates.items():
            own = len(found)
            size = len(template)
            slack = max(3, size // 4)
            at = sorted((i, k) for w, k in self.cues[name].items() for i in spots.get(w, ()))
            done = 0
            for i, k in at:
                if i < done:
                    continue
                lo = max(done, i - k - slack)
                pairs = patience(words[lo : i - k + size + slack], template)
                coverage = len(pairs) / size
                if coverage >= self.least and self._has_required(name, pairs):
                    match = Match(name, coverage, lo + pairs[0][0], lo + pairs[-1][0] + 1)
                    found.append(match)
                    done = match.end
            if name in seeds:
                found += self._interrupted(name, words, seeds[name], found[own:])
        return sorted(found, key=lambda m: (m.start, m.license))

    def _interrupted(
        self, name: str, words: list[str], seeds: list[tuple[int, int]], known: list[Match]
    ) -> Iterator[Match]:
        """Matches with foreign words inside, in the stretches between the ``known`` ones."""
        template = self.templates[name]
        size = len(template)
        starts, ends = [0, *(m.end for m in known)], [*(m.start for m in known), len(words)]
        at = 0
        for first, last in zip(starts, ends, strict=True):
            here = []
            while at < len(seeds) and seeds[at][0] + RUN <= last:
                if seeds[at][0] >= first:
                    here.append(seeds[at])
                at += 1
            if len(here) < 2:
                continue
            low, taken = first, False
            for chain in _chains(here):
                if taken and chain[0][0] < low:
                    continue  # the longest chain of all is for stretches without a match
                (i, j), (i1, j1) = chain[0], chain[-1]
                lo, hi = max(low, i - 2 * j), min(last, i1 + RUN + 2 * (size - j1 - RUN))
                pairs = chained(words, template, chain, lo, hi)
                if len(pairs) >= self.least * size and self._has_required(name, pairs):
                    yield Match(name, len(pairs) / size, pairs[0][0], pairs[-1][0] + 1)
                    low, taken = pairs[-1][0] + 1, True

    def _has_required(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        at = {j: i for i, j in pairs}
        return all(
            a in at and all(at.get(j) == at[a] + j - a for j in range(a, b)) for a, b in self.required[name]
        )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    min_coverage: float = MIN_COVERAGE,
    required: dict[str, tuple[str, ...]] = REQUIRED,
) -> DataFrame:
    """``(doc_id, matches)``, one row per input row; matches are ``(license, coverage, start, end)``.

    Places count words (runs of letters and digits).  A null or empty text matches
    nothing.  ``required`` lists words by template that a match must hold in a row, for
    templates that are close to other licenses; null and repeated ids keep their rows; an empty table gives an empty result;
    other columns are ignored.  A notice that stands twice matches twice.  Foreign words
    inside a notice, of any number, do not hide it; a text of any length is scanned whole.
    The last words of a notice may be matched up to a quarter of its length behind it,
    where they stand there too.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage, required)
        entry = pa.struct(
            [("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]
        )
        for batch in batches:
            rows = [
                [{"license": m.license, "coverage": m.coverage, "start": m.start, "end": m.end} for m in scanner.scan(t)]
                for t in text_column(batch)
            ]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "matches": pa.array(rows, pa.list_(entry))}
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    return mapped(rows, scan, schema)
