"""Shared kernels: batched text hashing, checkpoints, connected components.

Text arrives in Arrow batches; the kernels work on the raw UTF-8 buffer of a
bounded slice of documents, so no Python object exists per word.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call works on (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A table of bytes that maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WINDOW = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]
_pow = {_P: np.ones(1, np.uint64), _P_INV: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to one slice."""
    have = _pow[base]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        out = np.empty(size, np.uint64)
        out[0], k = 1, 1
        while k < size:
            np.multiply(out[:k], np.uint64(pow(base, k, 1 << 64)), out=out[k : 2 * k])
            k *= 2
        if size <= 2 * SLICE_BYTES:
            _pow[base] = out
        have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    arr = batch.column(column)
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as 64-bit hashes.

    ``hash[i]`` belongs to the text d with ``first[d] <= i < first[d+1]``;
    ``start``/``end`` are byte positions in ``data``. With a ``table`` of 256
    bytes, each byte stands for its entry.
    """

    def __init__(self, arr: pa.Array, table: np.ndarray | None = None):
        data, off = text_buffer(arr)
        if table is not None:
            data = table[data]
        self.data, self.offsets = data, off
        n = len(data)
        space = _SPACE[data]
        begin = ~space
        begin[1:] &= space[:-1]
        stop = ~space
        stop[:-1] &= space[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = ~space[inner]
        stop[inner - 1] = ~space[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_P, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(_P_INV, n + 1)[self.start]
        self.hash = mix(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(_P))
        self.space = space

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def windows(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words, by first word; those that reach into the next text mean nothing."""
        w = self.hash
        if len(w) < k:
            return np.zeros(0, np.uint64)
        out = w[: len(w) - k + 1] * _WINDOW[0]
        for j in range(1, k):
            out += w[j : len(w) - k + 1 + j] * _WINDOW[j]
        return mix(out)

    def shingle_sets(self, k: int, order=lambda h: h) -> Iterator[np.ndarray]:
        """Of each text, the sorted distinct shingles of k words; with fewer words the whole sequence is one.

        ``order`` maps hashes to the keys that stand for them, whose order is the sets' order.
        """
        win = order(self.windows(k))
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(win[a : b - k + 1])
            elif b > a:
                total = sum(int(x) * int(c) for x, c in zip(self.hash[a:b], _WINDOW[8:], strict=False)) + (b - a)
                yield order(mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64)))
            else:
                yield win[:0]


class Index:
    """Codes 0, 1, .. of 64-bit hashes, in an open-addressing table that is read and filled array by array."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.code = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 for those that aren't in it."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.code[slot]
        on = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.code)
            out[on] = self.code[slot[on]]
            on = on[(out[on] >= 0) & (self.keys[slot[on]] != h[on])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Give the next codes to distinct hashes that aren't in it."""
        code = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.code[slot] < 0
            self.keys[slot[free]], self.code[slot[free]] = h[free], code[free]
            on = self.code[slot] != code
            h, code, slot = h[on], code[on], (slot[on] + 1) % len(self.code)


#: What this Python worker keeps between its tasks: (owner, what), of one owner at a time.
_kept: list = []


def keep(owner: str, make: Callable):
    """``make()``, kept between the tasks of a worker until another owner keeps something."""
    if not _kept or _kept[0] != owner:
        release()
        _kept[:] = [owner, make()]
    return _kept[1]


def release() -> None:
    """Drop what the worker keeps, and give unused memory back to the system: later stages use the same workers."""
    _kept.clear()
    for base in _pow:
        _pow[base] = np.ones(1, np.uint64)
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends; unless it ``keeps`` things itself, it begins without what others keep."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        yield from run(batches)
        _trim()

    return each


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit integers, a null as 0, and never through floats."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder: the cluster's shared one, or (only where none is set, as in tests) one of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="planeframe-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared checkpoint folder, so the loss of an executor loses nothing."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit set that holds every id of a one-column frame, and few others: (words, bits of a position).

    Its size is 2 MB for small sets and 16 MB at most, when it lets more through:
    it saves shuffled rows, a join decides.
    """
    bits = int(np.clip(int(16 * ids.count() + 1).bit_length(), 24, 27))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_place(b.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int64)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    out = np.zeros(1 << (bits - 6), np.int64)
    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint64), bits


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def may_hold(filter_: tuple[np.ndarray, int], ids: np.ndarray) -> np.ndarray:
    at = _place(ids, filter_[1])
    return (filter_[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def distinct_keys(df: DataFrame, of: list[str], same: list[str] | None = None) -> F.Column:
    """An expression for a key of 63 bits over the columns ``of``, equal for two rows of ``df`` only if they agree in ``same`` (by default ``of``).

    A hash, checked by one shuffle of keys. Keys that stand for several contents,
    a handful in 10^10, are hashed again with another seed and checked again.
    """
    content = F.struct(*(same or of))
    key, seed = F.xxhash64(*of).bitwiseAND(F.lit((1 << 63) - 1)), 0
    while True:
        seen = df.select(key.alias("_key"), content.alias("_of")).groupBy("_key").agg(F.min("_of").alias("lo"), F.max("_of").alias("hi"))
        bad = [r[0] for r in seen.where("lo != hi").select("_key").collect()]
        if not bad:
            return key
        seed += 1
        key = F.when(key.isin(bad), F.xxhash64(F.lit(seed), *reversed(of)).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(key)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared checkpoint folder, smaller than checkpoint() makes it; removed at exit."""
    spark = with_checkpoints(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/planeframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        return


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component the smallest id.

    Alternates large-star and small-star steps, which keep a forest's total
    size at the number of edges however large a hub is. Each step is two
    shuffles; minima are combined before the shuffle. Ids on no edge are not
    returned; null ids and self links are ignored; no edges give no rows.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # after a large-star step every edge points from a node to a smaller one
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    heads = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)
