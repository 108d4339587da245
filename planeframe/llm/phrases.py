"""Operator 13: phrases whose words occur together more often than apart.

1. Each task counts the hashes of all n-grams into a count-min sketch: two rows
   of counters for each length. A sketch's width follows the size of the corpus,
   so it is never held whole: tasks hand on their non-zero counters by ranges of
   the counters, and one task sums the counters of a range.
2. Counters that reach the least count, few of all, become a bit set of at most
   16 MB. An n-gram is a survivor if both its counters are in it and both its
   (n-1)-grams survive. Sums only ever overestimate and the bit set only ever
   lets more through, so no frequent n-gram is lost.
3. A second pass over the text counts survivors exactly: words are told apart by
   a dictionary of the words themselves, n-grams by the pair (number of the first
   n-1 words, last word), and the counts of slices are added by the phrase.
4. Cuts are joined with the counts of their parts, phrases inside equally
   frequent longer ones go, and each language's best are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, _P, _P_INV, _WINDOW, LOWER, _powers, id_filter, may_hold, mix, slices, stored, text_buffer, tidy

#: Words of the longest phrase.
LONGEST = 5
#: Occurrences that a candidate has at least.
LEAST = 100
#: Share in percent of a phrase's occurrences at which a longer candidate around it replaces it.
INSIDE = 100
#: Phrases returned for each language.
TOP = 2000
#: Bytes of text for each counter of a sketch's row: some 30 words, so a counter that holds no frequent n-gram stays far below LEAST.
BYTES_A_COUNTER = 200
#: Words whose n-grams a task counts before it hands its counters on.
CHUNK = 1 << 21
#: Rows of phrases that a task holds before it adds them up.
HELD = 1 << 19

#: What a byte is: 0 part of a word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ROWS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93))


class Pieces:
    """Words of a slice of texts, A-Z lower-cased: hash, piece, place.

    ``room[i]`` is the number of words from word i to the end of its piece;
    ``text[i]`` is the row of the slice that word i is of.
    """

    def __init__(self, arr: pa.Array, lang: pa.Array):
        data, off = text_buffer(arr)
        data = LOWER[data]
        kind = _KIND[data]
        n, part = len(data), kind == 0
        begin, stop = part.copy(), part.copy()
        begin[1:] &= ~part[:-1]
        stop[:-1] &= ~part[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = part[inner]
        stop[inner - 1] = part[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        words = len(self.start)
        first = np.searchsorted(self.start, off)
        self.text = np.repeat(np.arange(len(arr)), np.diff(first))
        ends = np.cumsum(kind == 2)[self.start] if words else np.zeros(0, np.int64)
        last = np.flatnonzero(np.concatenate([(np.diff(ends) != 0) | (np.diff(self.text) != 0), [True]])) if words else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([[-1], last]))
        self.room = np.repeat(last, size) - np.arange(words) + 1
        self.data, self.part = data, part
        names = lang.dictionary_encode()
        self.langs, self.lang = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)[self.text]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_P, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(_P_INV, n + 1)[self.start]
        seeds = np.array([sum(int(_BYTE[x]) * pow(_P, k, 1 << 64) for k, x in enumerate(name.encode())) & 0xFFFFFFFFFFFFFFFF for name in self.langs] or [0], np.uint64)
        self.hash = mix(h ^ ((self.end - self.start).astype(np.uint64) * np.uint64(_P)) ^ mix(seeds)[self.lang])

    def ngrams(self) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hashes of n words by their first word) for each n; those that reach beyond a piece mean nothing."""
        w = self.hash
        total = w * _WINDOW[0]
        for n in range(1, LONGEST + 1):
            if n > 1:
                total = total[:-1] + w[n - 1 :] * _WINDOW[n - 1]
            yield n, mix(total)

    def strings(self) -> pa.Array:
        """The words themselves."""
        size = self.end - self.start
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(self.data[self.part]))])


def _counter(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counters of hashes in a row of ``width``, by the hashes' upper 53 bits."""
    return (((h * _ROWS[row]) >> np.uint64(11)).astype(np.float64) * (width * 2.0**-53)).astype(np.int64)


def _heavy(docs: DataFrame, least: int, width: int) -> DataFrame:
    """(id): counters of the merged sketches that reach ``least``, numbered through all rows."""
    span = max(1 << 16, -(-width // 1024))
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=1)
        held: dict[int, list[np.ndarray]] = {n: [] for n in range(1, LONGEST + 1)}
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, int, int, bytes]] = []
            for n, parts in held.items():
                h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                parts.clear()
                if not len(h):
                    continue
                for row in range(len(_ROWS)):
                    at = np.sort(_counter(h, row, width).astype(np.uint32 if width <= 1 << 32 else np.int64))
                    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    many = np.minimum(np.diff(np.concatenate([new, [len(at)]])), least).astype(kind)
                    at = at[new]
                    part = at // at.dtype.type(span)
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(at)]])
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        near = (at[a:b] - part[a] * at.dtype.type(span)).astype(np.uint32)
                        step = np.diff(near, prepend=np.uint32(0))
                        planes = np.concatenate([step.view(np.uint8).reshape(-1, 4).T.ravel(), many[a:b].view(np.uint8)])
                        rows.append((n * len(_ROWS) + row, int(part[a]), b - a, zstd.compress(planes.tobytes(), asbytes=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["row", "part", "size", "counters"])

        for batch in batches:
            for s in slices(batch, "text"):
                p = Pieces(s.column("text"), s.column("lang"))
                for n, h in p.ngrams():
                    held[n].append(h[p.room[: len(h)] >= n])
                words += len(p.start)
                if words >= CHUNK:
                    yield from flush()
                    words = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        key, sums = None, np.zeros(span, np.uint32)

        def reach() -> pa.RecordBatch:
            at = np.flatnonzero(sums >= least) + key[0] * width + key[1] * span
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["id"])

        for b in batches:
            for row, part, size, payload in zip(*(b.column(c).to_pylist() for c in ("row", "part", "size", "counters")), strict=True):
                if (row, part) != key:
                    if key is not None:
                        yield reach()
                    key = (row, part)
                    sums[:] = 0
                raw = np.frombuffer(zstd.decompress(payload, size * (4 + kind.itemsize), asbytes=True), np.uint8)
                step = np.ascontiguousarray(raw[: 4 * size].reshape(4, size).T).view(np.uint32).ravel()
                sums[np.cumsum(step, dtype=np.int64)] += raw[4 * size :].view(kind)
        if key is not None:
            yield reach()

    parts = docs.mapInArrow(tidy(count), "row int, part int, size int, counters binary")
    return parts.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(tidy(merge), "id long")


def _survivors(docs: DataFrame, seen: tuple[np.ndarray, int], width: int, least: int) -> DataFrame:
    """(lang, n, phrase, count): survivors with their exact counts, of ``least`` or more; n = 0 counts all words.

    Tasks add up what they find and hand it on in buckets by hash, a row each;
    one task adds up a bucket, a part at a time.
    """
    names = ["bucket", "lang", "n", "phrase", "count"]
    buckets = min(max(width >> 16, 64), 4096)

    def total(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names[:4]).aggregate([("count", "sum")]).rename_columns(names)

    def dealt(table: pa.Table) -> pa.RecordBatch:
        table = table.take(np.argsort(table["bucket"].to_numpy(), kind="stable")).combine_chunks()
        bucket = table["bucket"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
        off = pa.array(np.concatenate([first, [len(bucket)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(off, table[c].combine_chunks()) for c in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *lists], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = (held.value, seen[1])
        parts: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for s in slices(batch, "text"):
                p = Pieces(s.column("text"), s.column("lang"))
                if not len(p.start):
                    continue
                coded = p.strings().dictionary_encode()
                code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                langs = pa.array(p.langs, pa.string())
                many = np.bincount(p.lang, minlength=len(langs))
                out = [(np.zeros(len(langs), np.int32), langs, np.zeros(len(langs), np.int32), pa.array([""] * len(langs)), many)]
                number, alive = p.lang.astype(np.int64), np.ones(len(code) + 1, bool)
                for n, h in p.ngrams():
                    at = np.flatnonzero(alive[: len(h)] & alive[1 : len(h) + 1] & (p.room[: len(h)] >= n))
                    for row in range(len(_ROWS)):
                        ids = _counter(h[at], row, width) + (n * len(_ROWS) + row) * width
                        at = at[may_hold(filter_, ids)]
                    alive = np.zeros(len(code) + 1, bool)
                    if not len(at):
                        break
                    alive[at] = True
                    _, first, of, count = np.unique(number[at] * size + code[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                    number = np.zeros(len(code), np.int64)
                    number[at] = of
                    at = at[first]
                    words = [coded.dictionary.take(pa.array(code[at + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]
                    bucket = (h[at] % np.uint64(buckets)).astype(np.int32)
                    out.append((bucket, langs.take(pa.array(p.lang[at])), np.full(len(at), n, np.int32), phrase.cast(pa.string()), count))
                for bucket, lang, n, phrase, count in out:
                    parts.append(pa.Table.from_arrays([pa.array(bucket), lang, pa.array(n), phrase, pa.array(count, pa.int64())], names=names))
                    rows += len(count)
                if rows > HELD:
                    parts = [total(parts)]
                    rows = len(parts[0])
                    if 2 * rows > HELD:
                        yield dealt(parts.pop())
                        rows = 0
        if parts:
            yield dealt(total(parts))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, rows = None, [], 0

        def reach() -> list[pa.RecordBatch]:
            sums = total(parts).drop_columns("bucket")
            return sums.filter(pc.or_(pc.equal(sums["n"], 0), pc.greater_equal(sums["count"], least))).to_batches()

        for b in batches:
            for k, own in enumerate(b.column("bucket").to_pylist()):
                if own != bucket and parts:
                    yield from reach()
                    parts, rows = [], 0
                bucket = own
                lists = [b.column(c).slice(k, 1).flatten() for c in names[1:]]
                parts.append(pa.Table.from_arrays([pa.array(np.full(len(lists[0]), own, np.int32)), *lists], names=names))
                rows += len(lists[0])
                if rows > HELD:
                    parts = [total(parts)]
                    rows = 0
        if parts:
            yield from reach()

    held = docs.sparkSession.sparkContext.broadcast(seen[0])
    found = docs.mapInArrow(tidy(find), "bucket int, lang array<string>, n array<int>, phrase array<string>, count array<long>")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(merge), "lang string, n int, phrase string, count long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, width: int | None = None) -> DataFrame:
    """(lang, n, phrase, count): every phrase of 1 to 5 words found ``least`` times or more in a language, with its exact count.

    Rows with n = 0 and an empty phrase hold the number of all words of a
    language. ``width`` is the number of a sketch's counters; by default it follows the
    size of the text. A narrow sketch costs time, never a phrase.
    """
    docs = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    if width is None:
        width = max(1 << 16, int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_COUNTER)
    heavy = stored(_heavy(docs, least, width))
    return stored(_survivors(docs, id_filter(heavy), width, least))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, inside: int = INSIDE, top: int = TOP, width: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words.

    A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r)) in
    exact decimals. A phrase inside a longer candidate that has ``inside`` percent
    of its occurrences or more is left out. Null texts and empty texts have no
    words; a null language is ``und``; repeated rows count each; texts of any
    length are read whole; ties of score go to the more frequent phrase, then to
    the smaller one in byte order; an empty table gives no rows. Other columns of
    ``docs`` play no part.
    """
    counts = phrase_counts(docs, text_col, lang_col, least, width)
    totals = counts.where("n = 0").select("lang", F.col("count").alias("words"))
    longer = counts.where("n >= 2").withColumnRenamed("count", "a")
    part = counts.where(f"n between 1 and {LONGEST - 1}").select("lang", "phrase", "count")
    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, n - 1)"))).withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - n)")})
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(38,0)) * a * words) div (cast(l as decimal(38,0)) * r)").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # all proper contiguous parts of two words and more
    spans = longer.where("n >= 3").withColumns({"w": F.split("phrase", " "), "size": F.explode(F.expr("sequence(2, n - 1)"))}).withColumn("from", F.explode(F.expr("sequence(1, n - size + 1)")))
    around = spans.select("lang", F.expr("array_join(slice(w, from, size), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.expr(f"around is null or 100 * cast(around as decimal(38,0)) < {inside} * cast(a as decimal(38,0))"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS size))),
counts AS (SELECT lang, phrase, size, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, k, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS k FROM counts WHERE size >= 2) c
  JOIN totals t ON t.lang = c.lang
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b
  WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = b.lang AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND o.phrase <> b.phrase AND 100 * o.a >= 100 * b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
