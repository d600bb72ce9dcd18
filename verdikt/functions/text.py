"""Text helpers as Column expressions.

Whitespace and line breaks follow the Unicode sets that Python's ``strip``,
``split`` and ``splitlines`` use; Java's ``\\s`` and ``trim`` are narrower.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Java form (Unicode-aware \s plus the separators Python adds) and the same set for RE2.
SPACE = r"(?U)[\s\x1C-\x1F]"
RE2_SPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A lambda re-evaluates outer expressions for every element; an array that a
    lambda looks into must be bound (or be a plain column) first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def full_lines(c: Column) -> Column:
    """Stripped, non-blank lines in order."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def alnum_tokens(c: Column) -> Column:
    """Lowercase [a-z0-9]+ tokens in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(alnum_tokens(c))


def matched_text(c: Column) -> Column:
    """Underscores and punctuation folded away, tokens joined by one blank."""
    return F.array_join(alnum_tokens(F.translate(c, "_", " ")), " ")


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def has_any(c: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(c, F.lit(needle))
    return hit


def word_bound(phrase: str) -> str:
    """Pattern for a phrase not glued to other [a-z0-9] characters."""
    escaped = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in phrase)
    return f"(^|[^a-z0-9]){escaped}($|[^a-z0-9])"


def has_phrase(c: Column, phrase: str) -> Column:
    return c.rlike(word_bound(phrase))


def has_any_phrase(c: Column, phrases: Iterable[str]) -> Column:
    escaped = [word_bound(p) for p in phrases]
    return c.rlike("|".join(escaped))


def first_text(*cols: Column) -> Column:
    """First non-blank value among aliases, stripped; '' when none."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in cols], F.lit(""))


def joined_context(*cols: Column) -> Column:
    """Ordered distinct non-blank parts separated by a blank line."""
    parts = F.array(*[F.coalesce(strip(c.cast("string")), F.lit("")) for c in cols])
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "\n\n")


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard of two token sets (distinct arrays); ``empty`` is for two empty sets."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(empty)).otherwise(
        let(F.size(F.array_intersect(a, b)), lambda n: n / (both - n))
    )


def overlap_min(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(
        F.lit(1), F.least(F.size(a), F.size(b))
    )


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """Guarded division as double."""
    return F.when(whole == 0, F.lit(float(default))).otherwise(
        part.cast("double") / whole.cast("double")
    )
