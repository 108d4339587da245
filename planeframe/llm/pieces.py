"""SentencePiece encoding and decoding: batched Viterbi over equal-length words.

For a BPE model the encoder's result isn't the path of greatest total score, so
the Viterbi lattice here scores transitions: a piece may follow another one only
if merging their joint text gives just these two pieces. Under that rule each
prefix of a word has exactly one admissible last piece, so the vectorised maximum
over lengths finds it, and the path read backwards is the library's own result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, tidy

#: Distinct words whose pieces a worker remembers, and pairs of pieces whose verdict it remembers; beyond it each memory starts anew.
MEMO = 500_000
PAIRS = 2_000_000

SPACE = "▁"
#: Characters from which a word is encoded on its own, and places of it that are worked on at once.
LONG, LONG_BLOCK = 1000, 100_000
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_SALT = np.uint64(0xD1B54A32D192ED03)


def _code(chars: np.ndarray) -> np.ndarray:
    """Spread code points over 64 bits before they enter a polynomial."""
    x = (chars.astype(np.uint64) + np.uint64(1)) * _SALT
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


class PieceModel:
    """A SentencePiece BPE model with byte fallback and no normalisation, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ  a"  # a normaliser would change the ligature or the spaces
        if sp.decode(sp.encode(probe)) != probe or sp.encode(" a", out_type=str)[:1] != [SPACE]:
            raise ValueError(f"{path}: only models without normalisation and with a leading space are supported")
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, t in enumerate(text):
            if sp.is_byte(i):
                self.byte_id[int(t[3:5], 16)] = i
                self.bytes_of.append(bytes([int(t[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(t.replace(SPACE, " ").encode())
                self.id[t], self.score[t] = i, sp.get_score(i)
        bad = [t for t in self.id if SPACE in t.lstrip(SPACE)]
        if bad or not self.byte_id.all():
            raise ValueError(f"{path}: a piece crosses a space, or bytes are missing")
        self.longest = max(map(len, self.id))
        inner = {c for t in self.id if len(t) > 1 for c in t}
        #: Characters that stand in no longer piece: words may be split there.
        lone = "".join(c for c in "\n\r\t" if c not in inner)
        self.unit = regex.compile(rf"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        keys = np.array([self._hash(t) for t in self.id], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.fromiter(self.id.values(), np.int32, len(self.id))[order]
        #: Which beginnings of hashes any piece has: most substrings are none, and needn't be looked for among the sorted keys.
        self.some = np.zeros(1 << 20, bool)
        self.some[keys >> np.uint64(44)] = True
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.text = text
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.raw_size = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.pair: dict[int, bool] = {}
        self.clear()

    @staticmethod
    def _hash(t: str) -> int:
        h = 0
        for c in _code(np.array([ord(c) for c in t], np.uint32)).tolist():
            h = (h * int(_MUL) + c) & 0xFFFFFFFFFFFFFFFF
        return h

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def apart(self, x: str, y: str) -> bool:
        """Whether the text of two pieces merges into just these: best-scored neighbours first, leftmost of equal ones, and none across the border."""
        s, get, none = [*x, *y], self.score.get, -np.inf
        border = len(x)
        gain = [get(s[i] + s[i + 1], none) for i in range(len(s) - 1)]
        while gain:
            best = max(gain)
            if best == none:
                break
            i = gain.index(best)
            if i == border - 1:
                return False
            border -= i < border
            s[i : i + 2] = [s[i] + s[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = get(s[i - 1] + s[i], none)
            if i < len(gain):
                gain[i] = get(s[i] + s[i + 1], none)
        return s == [x, y]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joint text of pieces a and b (ids) merges into just these two."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        kinds, back = np.unique(key, return_inverse=True)
        if len(self.pair) > PAIRS:
            self.pair.clear()
        got = np.empty(len(kinds), bool)
        for i, k in enumerate(kinds.tolist()):
            v = self.pair.get(k)
            if v is None:
                v = self.pair[k] = self.apart(self.text[k >> 32], self.text[k & 0xFFFFFFFF])
            got[i] = v
        return got[back]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        v = self.pair.get(key)
        if v is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            v = self.pair[key] = self.apart(self.text[a], self.text[b])
        return v

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are a piece's, ids of the pieces)."""
        hit = np.flatnonzero(self.some[h >> np.uint64(44)])
        if len(hit):
            at = np.searchsorted(self.keys, h[hit])
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == h[hit]
            hit, at = hit[ok], at[ok]
            return hit, self.key_id[at]
        return hit, self.key_id[:0]

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of W words of L characters each (code points, W x L): their ids from the end (W x L, -1 beyond), and how many.

        An id of -2 stands for a character that no piece holds.
        """
        n, length = chars.shape
        code = _code(chars)
        pre = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            pre[i + 1] = pre[i] * _MUL + code[:, i]
        power = np.full(self.longest + 1, _MUL, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.zeros((length + 1, n), np.int32)  # length of the last piece of each prefix
        last = np.full((length + 1, n), -2, np.int32)
        for i in range(1, length + 1):
            best = np.ones(n, np.int32)
            piece = np.full(n, -2, np.int32)
            for k in range(1, min(i, self.longest) + 1):
                h = pre[i] - pre[i - k] * power[k]
                hit, own = self._probe(h)
                if not len(hit):
                    continue
                if i > k:
                    before = last[i - k, hit]
                    ok = before == -2
                    if not ok.all():
                        rest = np.flatnonzero(~ok)
                        ok[rest] = self.may_follow(before[rest], own[rest])
                    hit, own = hit[ok], own[ok]
                best[hit] = np.maximum(best[hit], k)
                piece[hit] = own
            back[i], last[i] = best, piece
        out = np.full((n, length), -1, np.int32)
        count = np.zeros(n, np.int64)
        pos = np.full(n, length)
        live = np.arange(n)
        while len(live):
            out[live, count[live]] = last[pos[live], live]
            count[live] += 1
            pos[live] -= back[pos[live], live]
            live = live[pos[live] > 0]
        return out, count

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word; words of one length advance together, in blocks of bounded size."""
        got: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            length = int(size[order[at]])
            to = min(int(np.searchsorted(size[order], length, "right")), at + max(1, 400_000 // length))
            block = order[at:to]
            if length > LONG:
                for i in block.tolist():
                    w = words[i]
                    got[i] = self._with_bytes(w, self._spaced(w) if w.startswith(SPACE * 2) else self._long(w))
                at = to
                continue
            chars = np.frombuffer("".join(words[i] for i in block).encode("utf-32-le"), np.uint32).reshape(-1, length)
            odd = [j for j, i in enumerate(block) if words[i].startswith(SPACE * 2)]
            out, count = self.viterbi(chars)
            for j, i in enumerate(block.tolist()):
                ids = out[j, : count[j]][::-1]
                if ids.min() == -2:
                    ids = self._with_bytes(words[i], ids)
                got[i] = ids
            for j in odd:  # runs of spaces: their pieces all have one score, so order decides
                w = words[block[j]]
                got[block[j]] = self._with_bytes(w, self._spaced(w))
            at = to
        return got

    def _spaced(self, w: str) -> np.ndarray:
        """A word after several spaces: all other merges come first, then the spaces merge among themselves."""
        body = w.lstrip(SPACE)
        head = len(w) - len(body)
        ids = self._long(SPACE + body).tolist() if body else []
        if ids and ids[0] == self.id.get(SPACE, -3):
            ids, free = ids[1:], head
        else:
            free = head - bool(body)
        return np.array([self.id.get(p, -2) for p in self._runs(free)] + ids, np.int32)

    def _runs(self, n: int) -> list[str]:
        """n spaces, merged by the best score and from the left, in n log n steps: a heap of neighbours over a linked list."""
        s: list[str | None] = [SPACE] * n
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-self.score[SPACE * 2], i, SPACE * 2) for i in range(n - 1)] if SPACE * 2 in self.score else []
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if s[i] else n
            if j >= n or s[i] + s[j] != both:
                continue
            s[i], s[j] = both, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else n
                if b < n and (score := self.score.get(s[a] + s[b])) is not None:
                    heapq.heappush(heap, (-score, a, s[a] + s[b]))
        return [x for x in s if x]

    def _long(self, word: str) -> np.ndarray:
        """As ``viterbi`` for one very long word: pieces are looked up at all places at once, a block at a time, then chosen place by place."""
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n = len(chars)
        last, back = [-2] * (n + 1), [0] * (n + 1)
        for at in range(0, n, LONG_BLOCK):
            low = max(0, at - self.longest)
            code = _code(chars[low : at + LONG_BLOCK])
            size = len(code)
            power = np.full(size + 1, _MUL, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
            inverse = np.full(size + 1, pow(int(_MUL), -1, 1 << 64), np.uint64)
            inverse[0] = 1
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(code * np.cumprod(inverse)[1:], out=total[1:])
            ids = np.full((self.longest + 1, size + 1), -1, np.int32)
            for k in range(1, min(size, self.longest) + 1):
                h = (total[k:] - total[:-k]) * power[k:]
                hit, own = self._probe(h)
                ids[k, k:][hit] = own
            some = ids >= 0
            options: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
            for k, i in zip(*np.nonzero(some), strict=True):
                options[i].append((int(k), int(ids[k, i])))
            for i in range(at + 1, at + LONG_BLOCK + 1 if at + LONG_BLOCK < n else n + 1):
                back[i] = 1
                for k, own in reversed(options[i - low]):
                    before = last[i - k]
                    if i == k or before == -2 or self._fits(before, own):
                        back[i], last[i] = k, own
                        break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= back[i]
        return np.array(out[::-1], np.int32)

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Replace -2 (a character without a piece) by the ids of its bytes."""
        out: list[int] = []
        at = 0
        for i in ids.tolist():
            if i == -2:
                out += self.byte_id[list(word[at].encode())].tolist()
                at += 1
            else:
                out.append(i)
                at += len(self.text[i])
        return np.array(out, np.int32)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.code]
        if len(self.code) + len(new) > MEMO and self.code:
            self.clear()
            new = list(words)
        got = self.encode_words(new)
        if not got:
            return
        n = np.fromiter(map(len, got), np.int64, len(got))
        at, to, end = len(self.code), len(self.code) + len(new), self.used + int(n.sum())
        self.first, self.size, self.ids = self._room(self.first, to), self._room(self.size, to), self._room(self.ids, end)
        self.first[at:to] = self.used + np.cumsum(n) - n
        self.size[at:to] = n
        self.ids[self.used : end] = np.concatenate(got)
        self.used = end
        self.code.update(zip(new, range(at, to), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets); an empty text has no ids."""
        split = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.code.__getitem__
        code = np.fromiter((get(w) for ws in split for w in ws), np.int64, sum(map(len, split)))
        n = self.size[code]
        total = np.cumsum(n)
        pos = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.first[code] - (total - n), n)
        words = np.cumsum([0, *map(len, split)])
        return self.ids[pos], np.concatenate([[0], total])[words]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as UTF-8: bytes of all pieces in a row, without the leading space."""
        n = self.raw_size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.raw[np.arange(int(total[-1])) + np.repeat(self.raw_first[ids] - total[:-1], n)].tobytes()
        ends = total[off].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def load(path: str) -> PieceModel:
    """The encoder of a file, kept between a worker's tasks."""
    return keep(f"PieceModel {path}", lambda: PieceModel(path))


def encode_pieces(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text.

    One pass, no shuffle. A null text counts as empty and has no ids; repeated
    rows give a row each; an empty table gives none; other columns are ignored.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = model.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return src.mapInArrow(tidy(run, keeps=True), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of piece ids; null or no ids give an empty text, bytes that aren't UTF-8 become U+FFFD."""
    src = encoded.select(encoded[id_col].cast("long").alias("doc_id"), F.coalesce(encoded[ids_col].cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            lists = b.column(1)
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in model.decode(ids, off)], pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(tidy(run, keeps=True), "doc_id long, text string")


def piece_digest(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, round_trip) of each row's whole text.

    ``round_trip`` says that decoding gives the text back; it fails only for
    texts that hold U+2581 itself, which the encoding takes for a space. Cases
    as in ``encode_pieces``.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                ids, off = model.encode(texts)
                back = model.decode(ids, off)
                raw = [t.encode() for t in texts]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                cols = [part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64()), pa.array([x == y for x, y in zip(raw, back, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])

    return src.mapInArrow(tidy(run, keeps=True), "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``piece_digest``."""
    import public_tokenizers

    return piece_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
