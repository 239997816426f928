"""Secret scan over a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression gives a Boolean query of trigrams that every match
must hold: an OR over the rule's mandatory literals, each an AND of its trigrams.
The index keeps postings (trigram, document) for the trigrams the rules can ask
for, over texts with A-Z lower-cased.  A rule's candidates are the intersection of
the postings of one literal, united over its literals.  Only candidates are
verified with the expression itself; a rule without a mandatory trigram reads
every text.

Spans are in code points: the pieces between matches, from ``split``, and the
matches, from ``regexp_extract_all``, are measured and summed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

# The standard library's own parser of regular expressions gives the syntax tree.
from re import _constants as rx
from re import _parser as rx_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.text import let
from tablerecon.llm.common import LOWER, UPPER, prepare, written


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``at_least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    at_least: int = 0

    @property
    def expression(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


# The three base rules, then further credential formats.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True,
        group=2,
        at_least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", at_least=20),
    Rule("hex", r"[0-9a-f]+", at_least=24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", at_least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", at_least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", at_least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", at_least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"Bearer\x20+([A-Za-z0-9._~+/=-]+)", group=1, at_least=16),
)
RULES = BASE_RULES + MORE_RULES

SPANS_AT_ONCE = 256  # matches that are appended to one array
MAX_LITERALS = 64  # a node with more alternatives counts as anything; the query only gets weaker


def mandatory_literals(pattern: str) -> list[set[str]]:
    """Sets of strings, A-Z lowered: every match holds one string of each set."""
    found: list[set[str]] = []

    def walk(nodes) -> set[str] | None:
        """The strings that these nodes can match, or None when there are too many to list."""
        run: set[str] = {""}
        whole = True

        def close() -> None:
            nonlocal run, whole
            found.append(run)
            run, whole = {""}, False

        for op, arg in nodes:
            options: set[str] | None = None
            if op is rx.LITERAL:
                options = {chr(arg).translate(str.maketrans(UPPER, LOWER))}
            elif op is rx.IN and all(o is rx.LITERAL for o, _ in arg):
                options = {chr(c).translate(str.maketrans(UPPER, LOWER)) for _, c in arg}
            elif op is rx.SUBPATTERN:
                options = walk(arg[-1])
            elif op is rx.BRANCH:
                parts = [isolated(branch) for branch in arg[1]]
                options = None if any(p is None for p in parts) else set().union(*parts)
            elif op is rx.MAX_REPEAT and arg[1] == 1:
                inner = isolated(arg[2])
                options = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            elif op is rx.MAX_REPEAT and arg[0] >= 1:
                inner = walk(arg[2])  # at least once, so what it must hold is mandatory
                if inner is not None:
                    found.append(inner)
            if options is None or len(run) * len(options) > MAX_LITERALS:
                close()
                if options is not None:
                    run = options
            else:
                run = {a + b for a in run for b in options}
        if whole:
            return run
        found.append(run)
        return None

    def isolated(nodes) -> set[str] | None:
        """As ``walk`` for a part that need not be matched: it adds nothing mandatory."""
        kept = len(found)
        out = walk(nodes)
        del found[kept:]
        return out

    whole = walk(list(rx_parser.parse(pattern)))
    if whole is not None:
        found.append(whole)
    return found


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of trigrams to hold together; None: no trigram is mandatory."""
    usable = [s for s in mandatory_literals(pattern) if all(len(x) >= 3 for x in s)]
    if not usable:
        return None
    best = max(usable, key=lambda s: min(len(x) for x in s))
    sets = {trigrams(x) for x in best}
    return sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)


def _both(a: Column, b: Column) -> Column:
    return a | b


def build_index(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings ``(trigram, key, check)`` of the ``wanted`` trigrams, each once per text."""
    folded = rows.select("key", "check", F.translate("text", UPPER, LOWER).alias("folded"))
    held = F.array_compact(
        F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in wanted])
    )
    return folded.select("key", "check", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, check, rules)``: per text, the kinds of the rules whose query it meets.

    Postings meet per text; a text has at most one posting per wanted trigram, so
    the set that is gathered is bounded by the rules, not by the data.
    """
    sets = index.groupBy("key", "check").agg(F.collect_set("trigram").alias("held"))
    hits = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query is not None:
            meets = [
                F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(needed)]), "held")) == 0
                for needed in query
            ]
            hits.append(F.when(reduce(_both, meets), F.lit(rule.kind)))
    kinds = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return sets.select("key", "check", kinds.alias("rules")).filter(F.size("rules") > 0)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end, kind)`` of one rule's matches, leftmost and not overlapping."""
    expression = F.lit(rule.expression)
    step = "struct<pos:bigint,spans:array<struct<start:bigint,end:bigint,kind:string>>>"
    pieces = F.zip_with(
        F.regexp_extract_all(text, expression, F.lit(0)),
        F.regexp_extract_all(text, expression, F.lit(rule.group)),
        lambda m, g: F.struct(
            F.char_length(m).cast("bigint").alias("len"), (F.char_length(g) >= rule.at_least).alias("ok")
        ),
    )
    gaps = F.transform(F.split(text, rule.expression, -1), lambda s: F.char_length(s).cast("bigint"))
    parts = F.arrays_zip(gaps.alias("gap"), pieces.alias("match"))
    zero = F.lit(0).cast("bigint")
    length = lambda part: part["gap"] + F.coalesce(part["match"]["len"], zero)

    def add(acc: Column, part: Column) -> Column:
        start = acc["pos"] + part["gap"]
        end = acc["pos"] + length(part)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.when(part["match"]["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("pos"), spans.alias("spans")).cast(step)

    # Appending copies what there is already: so the parts go in blocks, each from the place
    # where the block before it ends.
    def spread(parts: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / SPANS_AT_ONCE).cast("int")),
            lambda b: F.slice(parts, b * SPANS_AT_ONCE + 1, F.lit(SPANS_AT_ONCE)),
        )
        return let(blocks, placed)

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda n, part: n + length(part)))
        return let(sizes, lambda n: F.flatten(F.transform(blocks, lambda block, i: spans(block, F.slice(n, F.lit(1), i)))))

    def spans(block: Column, before: Column) -> Column:
        start = F.aggregate(before, zero, lambda n, size: n + size)
        state = F.struct(start.alias("pos"), F.array().alias("spans")).cast(step)
        return F.aggregate(block, state, add, lambda acc: acc["spans"])

    return let(parts, spread)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``(doc_id, spans)`` with one row per input row; spans are ``(start, end, kind)``.

    Spans are ordered by start, then by the rule's place in ``rules``.  A null text
    counts as empty and has no spans; rows that repeat an id and a text have equal
    results; null ids keep their rows.  An empty table gives an empty result; other
    columns are ignored.  Texts of any length and with any number of matches are read whole.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("check", F.xxhash64("text"))
    wanted = sorted({g for r in rules for needed in trigram_query(r.pattern) or [] for g in needed})
    none = F.array().cast("array<string>")
    if wanted:
        index = written(build_index(rows, wanted), "trigram-index")
        found = written(candidates(index, rules), "trigram-candidates")
        found = found.select(F.col("key").alias("c_key"), F.col("check").alias("c_check"), "rules")
        match = F.col("key").eqNullSafe(F.col("c_key")) & (F.col("check") == F.col("c_check"))
        rows = rows.join(found, match, "left").withColumn("rules", F.coalesce("rules", none))
    else:
        rows = rows.withColumn("rules", none)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    each = []
    for rule in rules:
        ask = F.col("text").rlike(rule.expression if rule.kind != "hex" else f"[0-9a-f]{{{rule.at_least}}}")
        if trigram_query(rule.pattern) is not None:
            ask = F.array_contains("rules", rule.kind) & ask
        each.append(F.when(ask, rule_spans(F.col("text"), rule)).otherwise(empty))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    keyed = F.transform(
        F.flatten(F.array(*each)),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return rows.select(F.col("key").alias("doc_id"), spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
