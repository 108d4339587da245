"""Quality rules: a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, slices, tidy

#: Documents on which each rule's cost and selectivity are estimated. They decide the order of rules only, never a verdict.
SAMPLE_ROWS = 256

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: 1 continuation, 2 white space, 3 symbol, 4 upper-case ASCII, 5 lower-case ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[list(SYMBOLS)] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Doc:
    """What a rule may look at: the text's bytes and the base counts, each taken when it is first asked for."""

    def __init__(self, part: np.ndarray, n_words: int, win: np.ndarray):
        self.part, self.n_words, self.win = part, n_words, win

    @cached_property
    def raw(self) -> bytes:
        return self.part.tobytes()

    @cached_property
    def classes(self) -> np.ndarray:
        return np.bincount(_CLASS[self.part], minlength=6)

    @property
    def word_chars(self) -> int:
        return int(len(self.part) - self.classes[1] - self.classes[2])

    @property
    def n_symbols(self) -> int:
        return int(self.classes[3])

    @cached_property
    def n_dup_lines(self) -> int:
        return _dup_lines(self.raw)

    @cached_property
    def n_repeat_words(self) -> int:
        return _repeated(self.win, 3)


def many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def odd_word_length(d: Doc) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words


def repeated_lines(d: Doc) -> bool:
    """At least three, and over three tenths of the lines: a header that a short text repeats once is no fault."""
    return d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * (d.raw.count(b"\n") + 1)


def exclamations(d: Doc) -> bool:
    return 5 * d.raw.count(b"!!") > d.n_words


def shouting(d: Doc) -> bool:
    """Over half of the letters of Latin-1 are capitals."""
    b = np.frombuffer(d.raw, np.uint8)
    upper, lower = np.count_nonzero((b >= 65) & (b <= 90)), np.count_nonzero((b >= 97) & (b <= 122))
    at = np.flatnonzero(b == 0xC3)
    if len(at):
        c = b[at + 1]
        letters = (c != 0x97) & (c != 0xB7)
        upper += np.count_nonzero(letters & (c < 0x9F))
        lower += np.count_nonzero(letters & (c >= 0x9F))
    return bool(2 * upper > upper + lower)


#: Each rule says whether it rejects a document; the verdict doesn't depend on their order.
RULES: dict[str, Callable[[Doc], bool]] = {f.__name__: f for f in (many_symbols, odd_word_length, repeated_lines, exclamations, shouting)}


def _repeated(win: np.ndarray, k: int) -> int:
    """Words covered by windows that stand at least twice."""
    if len(win) < 2:
        return 0
    s = np.sort(win)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(win, twice)
    cover = np.zeros(len(win) + k - 1, bool)
    for j in range(k):
        cover[j : j + len(win)] |= hit
    return int(cover.sum())


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def measure(arr: pa.Array) -> Iterator[Doc]:
    """The base counts of each text of a slice."""
    w = Words(arr)
    win = w.windows(3)
    for d in range(len(w)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        yield Doc(w.data[w.offsets[d] : w.offsets[d + 1]], b - a, win[a : max(a, b - 2)])


def too_short(d: Doc) -> bool:
    return d.n_words < 50


def repeats_itself(d: Doc) -> bool:
    return 100 * d.n_repeat_words > 50 * d.n_words


#: The base as rules: where only the verdict counts they take part in the cascade.
BASE: dict[str, Callable[[Doc], bool]] = {f.__name__: f for f in (too_short, repeats_itself)}


def base_failed(d: Doc) -> bool:
    return too_short(d) or repeats_itself(d)


def rule_order(texts: list[str | None], rules: dict[str, Callable[[Doc], bool]] = RULES) -> list[str]:
    """Rules by estimated rejection per cost on the given texts, highest first.

    With independent rules this order has the least expected cost, in which the
    counts that a rule needs have their part. Rules that reject nothing there
    come last, cheapest first.
    """
    cost, hits = {}, {}
    for name, rule in rules.items():
        docs = [d for d in measure(pa.array(texts, pa.string())) if rule in BASE.values() or not too_short(d)] if texts else []
        began = time.perf_counter()
        hits[name] = sum(rule(d) for d in docs)
        cost[name] = time.perf_counter() - began + 1e-9
    return sorted(rules, key=lambda k: (-(hits[k] / cost[k]), cost[k]))


def only_kept(documents: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that the base and the cascade keep, all columns as they are; cases as in ``quality_rules``."""
    rules = BASE | RULES
    order = rule_order([r[0] for r in documents.select(documents[text_col].cast("string")).limit(sample_rows).collect()], rules)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [rules[n] for n in order]
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([not any(rule(d) for rule in cascade) for d in measure(part.column(at))], pa.bool_()))

    return documents.mapInArrow(tidy(run), documents.schema)


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts and the cascade's verdict for each row.

    The order of the rules is estimated on ``sample_rows`` rows (bounded); each
    document then runs them until one rejects it. One pass over the text, no
    shuffle. A null text counts as empty and fails the base; repeated rows give
    a row each; an empty table gives no rows; other columns are ignored.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    order = rule_order([r[0] for r in src.select("text").limit(sample_rows).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [RULES[n] for n in order]
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for d in measure(part.column(1)):
                    failed = base_failed(d)
                    kept = not failed and not any(rule(d) for rule in cascade)
                    out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:5]), *(pa.array(c, pa.bool_()) for c in list(zip(*out, strict=True))[5:])], names=NAMES)

    return src.mapInArrow(tidy(run), OUT)


NAMES = [c.split()[0] for c in OUT.split(", ")]


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``quality_rules``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, string_split(x, chr(10)) AS l FROM t),
b AS (
  SELECT doc_id, x, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(l, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    len(l) AS n_lines,
    length(regexp_replace(x, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS up, length(regexp_replace(x, '[^a-zß-öø-ÿ]', '', 'g')) AS low,
    (length(x) - length(replace(x, '!!', ''))) // 2 AS bangs FROM w),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM p),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d WHERE n > 1) GROUP BY doc_id),
r AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 5 * bangs > n_words OR 2 * up > up + low) AS kept
FROM r
"""
