"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Index, Words, cut, keep, slices, tidy

#: Distinct words whose ids a worker remembers; beyond it the memory starts anew. The table has two places for each.
MEMO = 1 << 20
#: Words that the library gets at once: what it returns for each is some hundred times its ids.
AT_ONCE = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = f"{PIECES}, sequence_id long, offset long"


class WordIds:
    """Token ids of white-space-delimited words, each distinct word tokenized once by the library.

    Words are found and looked up by their 64-bit hashes, a slice at a time.
    Right for tokenizers whose pre-tokens never cross ASCII white space and
    which drop it; ``check`` refuses others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.check(path)
        self.clear()

    def check(self, path: str) -> None:
        a, b = "Probe'll x1", "(y) é!"
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        for gap in (" ", "\n", " \t ", "\x0b\x0c\r\n"):
            if ids(f"{gap}{a}{gap}{b}{gap}") != [i for c in f"{a} {b}".split() for i in ids(c)]:
                raise ValueError(f"{path}: its tokens depend on white space")

    def clear(self) -> None:
        self.index = Index((MEMO - 1).bit_length() + 1)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.first = np.zeros(MEMO, np.int64)
        self.size = np.zeros(MEMO, np.int32)

    def learn(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> None:
        """Tokenize distinct words, given by hash and place in the slice."""
        raw = words.data.tobytes()
        for i in range(0, len(at), AT_ONCE):
            part = at[i : i + AT_ONCE]
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[part].tolist(), words.end[part].tolist(), strict=True)]
            got = [e.ids for e in self.lib.encode_batch_fast(text, add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int32, len(got))
            k, to, end = self.index.n, self.index.n + len(part), self.used + int(n.sum())
            if to > len(self.first):  # one slice of more distinct words than the memory takes
                self.first, self.size = (np.concatenate([x, np.zeros(to, x.dtype)]) for x in (self.first, self.size))
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(end, np.uint32)])
            self.first[k:to] = self.used + np.cumsum(n) - n
            self.size[k:to] = n
            self.ids[self.used : end] = np.fromiter(chain.from_iterable(got), np.uint32, end - self.used)
            self.used = end
            self.index.add(hashes[i : i + AT_ONCE])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets)."""
        words = Words(texts)
        code = self.index.get(words.hash)
        lack = np.flatnonzero(code < 0)
        if len(lack):
            new, first = np.unique(words.hash[lack], return_index=True)
            at = lack[first]
            if self.index.n + len(new) > MEMO:
                self.clear()
                new, at = np.unique(words.hash, return_index=True)
                if len(new) > MEMO:
                    self.index = Index((len(new) - 1).bit_length() + 1)
                lack = np.arange(len(code))
            self.learn(words, new, at)
            code[lack] = self.index.get(words.hash[lack])
        n = self.size[code]
        total = np.cumsum(n, dtype=np.int64)
        pos = np.repeat(self.first[code] - (total - n), n)
        pos += np.arange(len(pos))
        return self.ids[pos], np.concatenate([[0], total])[words.first]


def load(path: str) -> WordIds:
    """The encoder of a file, kept between a worker's tasks."""
    return keep(f"WordIds {path}", lambda: WordIds(path))


def token_pieces(documents: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token ids of each text with ``end_id`` after them, cut at ``capacity``: a row per piece with the checksum of its ids."""
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = load(path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = lib.encode(part.column(1))
                out = []
                for d, doc in enumerate(part.column(0).to_pylist()):
                    own = np.concatenate([ids[off[d] : off[d + 1]], tail])
                    for k in range(0, len(own), capacity):
                        piece = own[k : k + capacity]
                        out.append((doc, k // capacity, k, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return src.mapInArrow(tidy(run, keeps=True), PIECES)


class Capacities:
    """A segment tree over remaining capacities 0..n that knows where open bins are."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.open = [False] * (2 * self.base)

    def set(self, r: int, value: bool) -> None:
        i = r + self.base
        self.open[i] = value
        while i > 1:
            i //= 2
            now = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def tightest(self, s: int) -> int | None:
        """The smallest capacity >= s that some open bin has."""
        i = s + self.base
        if self.open[i]:
            return s
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing, run on equal lengths and equal bins at once.

    Returns (length, first rank, items, first sequence, offset): the items of
    that length from that rank on go to consecutive sequences, one in each, at
    that offset. The packing is the one that item-by-item best-fit decreasing
    makes: the tightest open bin for each item, found in the segment tree; after
    one item of length s goes into the tightest bin, that bin stays the tightest
    until it is too small. Sequences of one remaining capacity are kept as runs
    of ids, so the plan's size depends on the capacity, not on the number of
    documents.
    """
    tree, runs = Capacities(capacity), defaultdict(list)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            runs[r].append((first, n))
            tree.set(r, True)

    for s in sorted(histogram, reverse=True):
        left, rank = histogram[s], 0
        while left:
            r = tree.tightest(s)
            if r is None:
                r, first, have = capacity, bins, -(-left // (capacity // s))
                bins += have
            else:
                first, have = runs[r].pop()
                if not runs[r]:
                    tree.set(r, False)
            each = r // s
            full = min(have, left // each)
            for j in range(each if full else 0):
                out.append((s, rank, full, first, capacity - r + j * s))
                rank += full
            left -= full * each
            put(r - each * s, first, full)
            first, have = first + full, have - full
            if left and have:
                for j in range(left):
                    out.append((s, rank, 1, first, capacity - r + j * s))
                    rank += 1
                put(r - left * s, first, 1)
                first, have, left = first + 1, have - 1, 0
            put(r, first, have)
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (columns of PIECES, length 1..capacity) its sequence and offset.

    Only the histogram of lengths (``capacity`` rows at most) goes to the
    driver; the plan made there is sent to the executors, its size bounded by
    the capacity too. Pieces of one length are numbered within (length, salt),
    with as many salts as there are shuffle partitions, so that a length that
    very many documents share is spread. Equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = cut(keyed.groupBy("length", "_salt").count())
    histogram = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = plan(histogram, capacity)
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    shift = np.int64(1) << np.int64(48)
    before = cells.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
        .join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")).hint("shuffle_hash"), ["length", "_salt"])
        .select(*[c.split()[0] for c in PIECES.split(", ")], (F.col("_rank") + F.col("_before")).alias("_rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * shift + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = np.searchsorted(starts, length * shift + rank, "right") - 1
            seq = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(table[row, 4])], names=[c.split()[0] for c in RESULT.split(", ")])

    return ranked.mapInArrow(tidy(run), RESULT)


def best_fit_packing(documents: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens: a row per piece (RESULT).

    A text longer than the capacity is cut into pieces of the capacity, the last
    one shorter. A null or empty text is the end token alone; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored. Texts
    are read once; their pieces (five numbers each) are checkpointed.
    """
    return pack(cut(token_pieces(documents, path, capacity, end_id, id_col, text_col)), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``best_fit_packing``."""
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
