"""String column functions: cleaning, keys and slugs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of key building.
EMPTY_SLUG = "preview"
EMPTY_SEGMENT = "PREVIEW"
KEY_JOINER = "__"
HASH_JOINER = "_"
HASH_DIGITS = 6
KEY_MAX_LEN = 32
PART_RESERVE = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Branches of a ``when`` share no subexpressions; a costly one, such as a
    regular expression over a long text, is bound to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(col: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def full_name(first: Column, last: Column) -> Column:
    """Both names stripped and joined by one space; null if either is null."""
    return F.concat(strip_space(first), F.lit(" "), strip_space(last))


def clean_names(
    df: DataFrame,
    email: str = "email",
    first: str = "first_name",
    last: str = "last_name",
    out: str = "full_name",
) -> DataFrame:
    """Lower-case the e-mail and add the full name; other columns stay."""
    return df.withColumns(
        {email: F.lower(F.col(email)), out: full_name(F.col(first), F.col(last))}
    )


def event_day(ts: Column) -> Column:
    """The first ten characters of the timestamp's text."""
    return F.substring(ts.cast("string"), 1, 10)


def _collapse(col: Column, keep: str, if_empty: str) -> Column:
    joined = F.btrim(F.regexp_replace(col, f"[^{keep}]+", "_"), F.lit("_"))
    return let(joined, lambda j: F.when(j == "", F.lit(if_empty)).otherwise(j))


def slugify(col: Column) -> Column:
    return _collapse(F.lower(col), "a-z0-9", EMPTY_SLUG)


def sanitize_key(col: Column) -> Column:
    return _collapse(F.upper(col), "A-Z0-9_", EMPTY_SEGMENT)


def bounded_key(base: Column, slug: Column, max_len: int = KEY_MAX_LEN) -> Column:
    """``BASE__PART``, cut and suffixed by a short hash of ``slug`` if too long."""
    room = max_len - len(KEY_JOINER) - len(HASH_JOINER) - HASH_DIGITS
    head = F.substring(base, 1, max(1, room - PART_RESERVE))
    mark = F.upper(F.substring(F.sha1(slug), 1, HASH_DIGITS))

    def fitted(part: Column) -> Column:
        whole = F.concat(base, F.lit(KEY_JOINER), part)
        rest = F.substr(part, F.lit(1), F.greatest(F.lit(1), F.lit(room) - F.length(head)))
        cut = F.concat(head, F.lit(KEY_JOINER), rest, F.lit(HASH_JOINER), mark)
        return F.when(F.length(whole) <= max_len, whole).otherwise(cut)

    return let(sanitize_key(slug), fitted)


def dotted(*parts: Column) -> Column:
    """``a.b``; null if any part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit("."))
        pieces.append(part.cast("string"))
    return F.concat(*pieces)


def address(resource_type: Column, name: Column) -> Column:
    return dotted(resource_type, name)


def full_ref(project: Column, name: Column) -> Column:
    return dotted(project, name)
