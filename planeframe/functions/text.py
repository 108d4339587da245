"""Lexical scoring as native expressions."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
HYPHENATED = r"[\p{L}\p{N}_-]+"


def fold(c: Column | str) -> Column:
    """Case folding: lower case, and the one letter of which that isn't enough."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold_text(s: str) -> str:
    return s.lower().replace("ß", "ss")


@cache
def letters(upper: bool) -> tuple[str, str]:
    """Letters that have another case, and that case of each, one letter for one letter; letters whose other case is several stay."""
    other = (lambda c: "ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)) if upper else lambda c: c.lower()[0]
    pairs = [(c, other(c)) for c in map(chr, range(0x20000)) if other(c) != c]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


def upper_letters(c: Column | str) -> Column:
    """Upper case letter by letter, so that a text keeps its length: ẞ of ß, where Spark's upper makes SS of it."""
    return F.translate(c, *letters(True))


def lower_letters(c: Column | str) -> Column:
    """Lower case letter by letter: a last sigma is a sigma like any other, and İ is one letter, i."""
    return F.translate(c, *letters(False))


def query_tokens(query: str, hyphen: bool = False) -> list[str]:
    return sorted(set(re.findall(r"[\w-]+" if hyphen else r"\w+", fold_text(query))))


def words(c: Column | str, pattern: str = WORD) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(pattern), F.lit(0)))


def overlap(c: Column | str, tokens: list[str], pattern: str = WORD) -> Column:
    """How many of the tokens the text holds."""
    if not tokens:
        return F.lit(0)
    return F.size(F.array_intersect(F.array(*map(F.lit, tokens)), words(c, pattern)))


def lexical_score(c: Column | str, query: str) -> Column:
    """The share of the query's words that the text holds, or 1 if it holds the query as a phrase; null text scores 0."""
    tokens = query_tokens(query)
    share = overlap(c, tokens) / F.lit(float(max(1, len(tokens))))
    phrase = F.when(F.contains(fold(c), F.lit(fold_text(query))), 1.0).otherwise(0.0)
    return F.coalesce(F.round(F.greatest(share, phrase), 8), F.lit(0.0))


def quoted(c: Column | str) -> Column:
    """Percent-encoding of a path segment."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("+", "%20"), ("%7E", "~"), ("*", "%2A")), F.url_encode(c))
