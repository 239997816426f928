"""A page's blocks of text, and what its markup says about them."""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

# Element and attribute words of HTML pages.
RAW = "script style noscript template title textarea svg iframe object".split()
LEFT_OUT = set(RAW) | set("nav header footer aside form menu dialog button select label datalist canvas audio video map head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
MAIN = {"article", "main"}
SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription social share sharing related recommended recommendations promo promotion sponsor sponsored comment "
    "comments disqus replies reply pagination pager toolbar widget widgets login signup signin search skip".split()
)
SIDE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Words around a side word that leave the name's meaning: "ad-slot", "site-footer".
SHAPE_WORDS = set(
    "area bar block box button buttons column container content feed form group header heading inner item items label layout "
    "link links list main page panel post posts row section site slot story strip title top unit wrap wrapper".split()
)
# What a start tag ends that was left open, and the elements that this does not reach beyond.
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_SCOPE = {"td", "th", "caption", "table", "button", "object", "html", "body"}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])[^>]*/>"  # an element of another language may close itself
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s>/])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")

# Inside an article; undecided; menus, adverts and the like; what a wrapper's name alone makes such.
STATED, OPEN, SIDE, WRAPPED = 0, 1, 2, 3


@dataclass(frozen=True)
class Block:
    text: str
    kind: int
    article: bool = False  # inside <article>, not in <main> alone


def _side_name(value: str, inside: bool) -> int:
    """What the classes or the id of an element say: SIDE, WRAPPED, or nothing (OPEN).

    A name is a side word itself (SIDE), or a side word among words of shape (WRAPPED);
    inside an article both are parts of it that are no text of it, but its header is.
    """
    found = OPEN
    for name in value.split():
        words = set(_WORD.findall(name))
        side = words & SIDE_WORDS
        if inside:
            side -= {"header", "masthead"}
        if not side or words - SIDE_WORDS - SHAPE_WORDS:
            continue
        if len(words) == 1 or inside:
            return SIDE
        found = WRAPPED
    return found


def _side(name: str, attrs: str, inside: bool) -> int:
    """Whether an element's text is beside the article (SIDE), perhaps beside it (WRAPPED), or not (OPEN)."""
    if name == "form":
        return SIDE if inside else WRAPPED
    # a header inside an article holds the article's headings
    if name in LEFT_OUT and not (inside and name == "header"):
        return SIDE
    if not attrs or name in ("html", "body") or name in MAIN:
        return OPEN
    found = OPEN
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return SIDE
        if key == "role" and value in SIDE_ROLES:
            return SIDE
        if key == "style" and "display:none" in value.replace(" ", ""):
            return SIDE
        if key in ("class", "id"):
            said = OPEN if inside and name in HEADINGS else _side_name(value, inside)
            if said == SIDE:
                return SIDE
            found = max(found, said)
    return found


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, references decoded, white space made single.

    Elements left open end where HTML lets their end be left out: a paragraph at the next
    block, items, cells and rows at the next one of their list or table.  An end tag closes
    what was opened inside its element, the end of the page closes everything.  A form, or a
    wrapper that is beside the article by a part of its name only, does not hide an article
    opened inside it.
    """
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, side, and the wrappers that an article set aside
    side = wrapped = main = article = 0

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                kind = SIDE if side else WRAPPED if wrapped else STATED if main else OPEN
                out.append(Block(text, kind, article > 0))

    def pop() -> str:
        nonlocal side, wrapped, main, article
        name, was, aside = stack.pop()
        side -= was == SIDE
        wrapped += aside - (was == WRAPPED)
        main -= name in MAIN
        article -= name == "article"
        return name

    def end(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in scope:
                return

    at = 0
    for mark in _MARK.finditer(page):
        if mark.start() > at:
            parts.append(page[at : mark.start()])
        at = mark.end()
        name = (mark["name"] or "").lower()
        if not name:
            continue
        if name in VOID and name != "hr":
            if name == "br":
                parts.append(" ")
            elif name not in INLINE:
                flush()
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if mark["close"]:
            if any(n == name for n, *_ in stack):
                while pop() != name:
                    pass
            continue
        if name in CLOSES_P:
            end({"p"}, P_SCOPE)
        if name in IMPLIED_ENDS:
            end(*IMPLIED_ENDS[name])
        if name == "hr" or mark["attrs"].endswith("/") and inline:
            continue
        says = _side(name, mark["attrs"], main > 0)
        if inline and says in (SIDE, WRAPPED):
            flush()
        aside = wrapped if name in MAIN else 0
        stack.append((name, says, aside))
        side += says == SIDE
        wrapped += (says == WRAPPED) - aside
        main += name in MAIN
        article += name == "article"
    parts.append(page[at:])
    flush()
    return out


# Bits that the rows of one alignment may take; longer ones are divided first.
_MOST_BITS = 1 << 28
_MOST_PAIRS = 1 << 20
_BLOCK = 4_096  # places of a line that one number holds


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence of ``a`` and ``b``.

    Equal starts and ends are taken off.  Long rests with few equal pairs are aligned pair by
    pair (Hunt and Szymanski), others divided where the lengths of both halves add up to the
    whole (Hirschberg): memory grows with the lines, not with their product.
    """
    shared = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            shared[i] = True
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            shared[m - 1] = True
            m, n = m - 1, n - 1
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= _MOST_BITS or n - j < 2:
            for k, both in enumerate(_aligned(a[i:m], b[j:n]), i):
                shared[k] = both
            continue
        times = Counter(b[j:n])
        if sum(times[x] for x in a[i:m]) <= _MOST_PAIRS:
            for k in _by_pairs(a[i:m], b[j:n]):
                shared[i + k] = True
            continue
        middle = (j + n) // 2
        front = _lengths(a[i:m], b[j:middle])
        back = _lengths(a[i:m][::-1], b[middle:n][::-1])
        cut = max(range(m - i + 1), key=lambda k: front[k] + back[m - i - k])
        todo += [(i, i + cut, j, middle), (i + cut, m, middle, n)]
    return shared


def _by_pairs(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` on a longest common subsequence, from the pairs of equal lines."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the smallest end in b of a subsequence of each length
    held: list[int] = []  # the pair it ends with
    place, before = array("q"), array("q")
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            place.append(i)
            before.append(held[k - 1] if k else -1)
            ends[k : k + 1], held[k : k + 1] = [j], [len(place) - 1]
    out, at = [], held[-1] if held else -1
    while at >= 0:
        out.append(place[at])
        at = before[at]
    return out


def _places(a: list[int], wanted: set[int]) -> dict[int, int]:
    """The places of each wanted line as the bits of a number."""
    held: dict[int, bytearray] = {}
    for i, x in enumerate(a):
        if x in wanted:
            row = held.setdefault(x, bytearray())
            row.extend(bytes(i // 8 + 1 - len(row)))
            row[i // 8] |= 1 << (i % 8)
    return {x: int.from_bytes(row, "little") for x, row in held.items()}


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of ``b`` with each start of ``a``, block by block."""
    known = set(b)
    carries = bytearray(len(b))  # of the additions, from one block to the next
    out = [0]
    for start in range(0, len(a), _BLOCK):
        block = a[start : start + _BLOCK]
        places, width = _places(block, known), len(block)
        full = grown = (1 << width) - 1
        for t, y in enumerate(b):
            hit = grown & places.get(y, 0)
            total = grown + hit + carries[t]
            carries[t] = total >> width
            grown = (total | (grown - hit)) & full
        for i in range(width):
            out.append(out[-1] + (not grown >> i & 1))
    return out


def _aligned(a: list[int], b: list[int]) -> list[bool]:
    """``common_lines`` row by row in bits: a zero bit is a place of ``a`` where the length grows."""
    places = _places(a, set(b))
    full = (1 << len(a)) - 1
    grown, rows = full, []
    for y in b:
        hit = grown & places.get(y, 0)
        grown = ((grown + hit) | (grown - hit)) & full
        rows.append(grown)
    shared = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            shared[i] = True
    return shared
