"""Token counts by byte-level BPE: rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, tidy

#: Distinct strings whose result a worker remembers; beyond it the memory starts anew.
MEMO = 600_000

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that no pre-token crosses, so that equal runs are worked on once.
_UNIT = regex.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_NONE = np.int32(2**31 - 1)


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary as arrays: symbols of bytes, sorted pair keys, their ranks and products."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        vocab = model["vocab"]
        self.size = len(vocab)
        self.byte = np.array([vocab[c] for _, c in sorted(_byte_symbols().items())], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain added tokens are supported")
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memo: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or _NONE."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty byte string.

        All strings advance together: in each round every string merges all
        (non-overlapping, from the left) places of its own lowest-rank pair.
        Only the ranks beside a merge are looked up again, and a string without
        a pair leaves the arrays.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = size.copy()
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.arange(len(pieces))
        last = np.cumsum(size) - 1
        rank = np.empty(len(ids), np.int32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[last] = _NONE
        while len(who):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            live = low < _NONE
            if not live.all():
                keep = np.repeat(live, size)
                out[who[~live]] = size[~live]
                ids, rank, who, size, low = ids[keep], rank[keep], who[live], size[live], low[live]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            near = np.empty(len(at), bool)
            near[0] = False
            np.equal(at[1:], at[:-1] + 1, out=near[1:])
            if near.any():  # a pair of equal symbols overlaps itself: take every other place of a run
                head = np.maximum.accumulate(np.where(near, -1, at))
                at = at[(at - head) % 2 == 0]
            owner = np.searchsorted(np.cumsum(size), at, "right")
            ids[at] = self.product[low[owner]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            size = size - np.bincount(owner, minlength=len(size))
            at = at - np.arange(len(at))
            tail = np.zeros(len(ids), bool)
            tail[np.cumsum(size) - 1] = True
            redo = np.unique(np.concatenate([at, at[at > 0] - 1]))
            redo = redo[~tail[redo]]
            rank[redo] = self.ranks(ids[redo], ids[redo + 1]) if len(redo) else rank[redo]
            rank[tail] = _NONE
        return out

    def units(self, text: str) -> tuple[list[str], int]:
        """Runs of the text that are counted apart, and how many special tokens it holds."""
        if self.splitter is None or not self.splitter.search(text):
            return _UNIT.findall(text), 0
        parts = self.splitter.split(text)
        return [u for p in parts for u in _UNIT.findall(p)], len(parts) - 1

    def learn(self, units: set[str]) -> None:
        """Count the units that the memory lacks."""
        new = [u for u in units if u not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(units)
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            pieces = [[p.encode() for p in self.pattern.findall(u)] for u in part]
            each = self.counts([p for ps in pieces for p in ps])
            n = np.fromiter(map(len, pieces), np.int64, len(pieces))
            self.memo.update(zip(part, np.add.reduceat(each, np.cumsum(n) - n).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.units(t) for t in texts]
        self.learn(set().union(*(u for u, _ in split)))
        get = self.memo.__getitem__
        return [sum(map(get, u)) + k for u, k in split]


def load(path: str) -> ByteBPE:
    """The encoder of a file, kept between a worker's tasks."""
    return keep(f"ByteBPE {path}", lambda: ByteBPE(path))


def token_counts(documents: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    ``path`` names a byte-level BPE file that each executor reads for itself.
    One pass, no shuffle. A null text counts as empty (no tokens); repeated
    rows give a row each; an empty table gives none; other columns are ignored.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1)
                n = pa.array(bpe.count(texts.to_pylist()), pa.int64())
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(tidy(run, keeps=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``token_counts``."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
