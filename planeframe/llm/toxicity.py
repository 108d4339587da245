"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares words as byte strings: every three bytes within a short
window, gaps allowed, weighted by the gap. A text scores as its most toxic word
does, so labels of whole texts train it as bags of words.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Index, Words, slices, tidy

#: Bound of the training sample: toxic and clean rows, and the longest text (characters) taken into it.
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 1500, 4500, 8000
#: Bits of the feature table, window of a subsequence, decay per skipped byte, bytes of a word that are looked at in a piece.
BITS, WINDOW, DECAY, PIECE = 16, 5, 0.5, 48
#: Landmarks of each side, weight of errors, rounds of choosing each toxic text's word anew.
LANDMARKS, COST, ROUNDS = 96, 10.0, 4
#: Strings that are worked on at once while fitting, and the cost of a clean word beside all toxic ones together.
BLOCK, CLEAN_COST = 8192, 0.16
#: Distinct words whose score a worker remembers; beyond it the memory starts anew.
MEMO = 1 << 20

_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TRIPLES = [(j, k, DECAY ** (k - 2)) for k in range(2, WINDOW) for j in range(1, k)]


def trim(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without up to three marks of punctuation at either end."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += (end - start > 1) & _EDGE[words.data[start]]
        end -= (end - start > 1) & _EDGE[words.data[end - 1]]
    return start, end


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, use) -> None:
    """Call use(rows, table index, weight) for every kernel feature of the byte strings, an array of equal lengths at a time.

    A string longer than PIECE is worked on in overlapping pieces by the caller.
    Strings get a mark at their begin, so a stem counts more in front.
    """
    size = end - start
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), 20_000):
            r = rows[at : at + 20_000]
            m = np.empty((n + 1, len(r)), np.uint32)
            m[0] = 1
            for i in range(n):
                m[i + 1] = data[start[r] + i]
            for i in range(n - 1):
                for j, k, w in _TRIPLES:
                    if i + k <= n:
                        h = (m[i] * np.uint32(0x9E3779B1) ^ m[i + j] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) ^ m[i + k] * np.uint32(0x165667B1)
                        use(r, (h * np.uint32(0x2545F491)) >> np.uint32(32 - BITS), w)


class Scorer:
    """The machine as one weight per feature: its landmarks are folded into the table, so a word costs its own features only."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, slope, shift
        self.clear()

    def __getstate__(self):
        return self.table, self.bias, self.slope, self.shift

    def __setstate__(self, state):
        self.__init__(*state)

    def clear(self) -> None:
        self.index = Index((MEMO - 1).bit_length() + 1)
        self.margin_of = np.zeros(MEMO, np.float32)

    def margins(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The decision value of each byte string; the greatest of its pieces for a long one."""
        if (end - start > PIECE).any():
            owner, lo, hi = [], [], []
            for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                for c in range(a, max(a + 1, b - WINDOW), PIECE - WINDOW):
                    owner.append(i)
                    lo.append(c)
                    hi.append(min(b, c + PIECE))
            out = np.full(len(start), -np.inf)
            np.maximum.at(out, np.array(owner), self.margins(data, np.array(lo), np.array(hi)))
            return out
        total, norm = np.zeros(len(start)), np.full(len(start), 1e-9)

        def use(r: np.ndarray, at: np.ndarray, w: float) -> None:
            total[r] += w * self.table[at]
            norm[r] += w * w

        features(data, start, end, use)
        return total / np.sqrt(norm) + self.bias

    def texts(self, arr: pa.Array) -> np.ndarray:
        """The greatest margin of each text; -inf without a word."""
        words = Words(arr, LOWER)
        out = np.full(len(words), -np.inf)
        if not len(words.hash):
            return out
        code = self.index.get(words.hash)
        lack = np.flatnonzero(code < 0)
        if len(lack):
            new, first = np.unique(words.hash[lack], return_index=True)
            at = lack[first]
            if self.index.n + len(new) > MEMO:
                self.clear()
                new, at = np.unique(words.hash, return_index=True)
                lack = np.arange(len(code))
                if len(new) > MEMO:
                    self.index, self.margin_of = Index((len(new) - 1).bit_length() + 1), np.zeros(len(new), np.float32)
            start, end = trim(words)
            self.margin_of[self.index.n : self.index.n + len(new)] = self.margins(words.data, start[at], end[at])
            self.index.add(new)
            code[lack] = self.index.get(words.hash[lack])
        each = self.margin_of[code].astype(np.float64)
        full = np.flatnonzero(np.diff(words.first))
        out[full] = np.maximum.reduceat(each, words.first[full])
        for d, raw in spelled(words):
            b = np.frombuffer(raw, np.uint8)
            out[d] = max(out[d], self.margins(b, np.array([0]), np.array([len(b)]))[0])
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated probability of the label."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.slope * np.maximum(margin, -3.0) + self.shift)))


def spelled(words: Words) -> Iterator[tuple[int, bytes]]:
    """Runs of at least three words of one letter, joined: an insult that is spelled out with spaces."""
    start, end = trim(words)
    one = (end - start == 1) & ~_EDGE[words.data[start]]
    if np.count_nonzero(one) < 3:
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 3:
            cuts = [a, *(c for c in words.first.tolist() if a < c < b), b] if np.any((words.first > a) & (words.first < b)) else [a, b]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x >= 3:
                    yield int(np.searchsorted(words.first, x, "right")) - 1, words.data[start[x:y]].tobytes()


def pieces(word: bytes) -> list[bytes]:
    """A word in the overlapping pieces that the scorer looks at."""
    return [word[a : a + PIECE] for a in range(0, max(1, len(word) - WINDOW), PIECE - WINDOW)] if len(word) > PIECE else [word]


def bags(texts: list[str]) -> list[list[bytes]]:
    """The distinct words of each text, trimmed and lower-cased; of long words the pieces."""
    one: dict[bytes, bytes] = {}  # equal words are one object
    out: list[list[bytes]] = []
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), 0) if texts else ():
        words = Words(part.column(0), LOWER)
        start, end = trim(words)
        raw = words.data.tobytes()
        own = [sorted({one.setdefault(x := raw[a:b], x) for a, b in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)}) for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        for d, s in spelled(words):
            own[d].append(s)
        out += [[one.setdefault(x, x) for w in b for x in pieces(w)] if any(len(w) > PIECE for w in b) else b for b in own]
    return out


class Landmarks:
    """Normed feature vectors of few strings, over the features that any of them has: ``by[column[f]]`` are feature f's weights, row 0 is empty."""

    def __init__(self, strings: list[bytes]):
        data, start, end = _packed(strings)
        found: list[tuple[np.ndarray, np.ndarray, float]] = []
        norm = np.full(len(strings), 1e-9)

        def use(r: np.ndarray, at: np.ndarray, w: float) -> None:
            found.append((r, at.astype(np.int64), w))
            norm[r] += w * w

        features(data, start, end, use)
        self.features = np.unique(np.concatenate([at for _, at, _ in found])) if found else np.zeros(0, np.int64)
        self.column = np.zeros(1 << BITS, np.int32)
        self.column[self.features] = np.arange(1, len(self.features) + 1)
        self.by = np.zeros((len(self.features) + 1, len(strings)), np.float32)
        for r, at, w in found:
            self.by[self.column[at], r] += np.float32(w)
        self.by /= np.sqrt(norm).astype(np.float32)

    def gram(self) -> np.ndarray:
        return (self.by.T @ self.by).astype(np.float64)

    def kernel(self, strings: list[bytes]) -> np.ndarray:
        """Kernel values of strings (rows) with the landmarks (columns)."""
        out, norm = np.zeros((len(strings), self.by.shape[1]), np.float32), np.full(len(strings), 1e-9)

        def use(r: np.ndarray, at: np.ndarray, w: float) -> None:
            col = self.column[at]
            on = np.flatnonzero(col)
            out[r[on]] += np.float32(w) * self.by[col[on]]
            norm[r] += w * w

        features(*_packed(strings), use)
        out /= np.sqrt(norm)[:, None].astype(np.float32)
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """A weight for each feature, so that a string's product with it is the weighted sum of its kernel values."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.by[1:] @ weights
        return table


def _machine(blocks: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss by Newton steps on the active rows; the rows come in blocks."""
    edge = np.cumsum([0, *map(len, blocks)])
    size = blocks[0].shape[1] + 1
    w, active, reg = np.zeros(size), np.ones(len(y), bool), np.eye(size)
    reg[-1, -1] = 1e-3
    for _ in range(30):
        left, right, value = reg.copy(), np.zeros(size), np.empty(len(y))
        for a, b, z in zip(edge[:-1], edge[1:], blocks, strict=True):
            on = active[a:b]
            z = np.concatenate([z[on], np.ones((np.count_nonzero(on), 1))], axis=1)
            part = (z * weight[a:b][on][:, None]).T
            left += part @ z
            right += part @ y[a:b][on]
        w = np.linalg.solve(left, right)
        for a, b, z in zip(edge[:-1], edge[1:], blocks, strict=True):
            value[a:b] = z @ w[:-1] + w[-1]
        now = y * value < 1
        if (now == active).all():
            break
        active = now
    return w


def _values(scorer: Scorer, words: list[bytes]) -> np.ndarray:
    return np.concatenate([scorer.margins(*_packed(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)])


def _settled(marks: Landmarks, to: np.ndarray, times: dict[bytes, int], everyday: list[bytes]) -> tuple[Scorer, np.ndarray]:
    """The machine of toxic words (with how often each was chosen) against all everyday words, and the values of the latter.

    It begins with some everyday words and takes in those that its margin doesn't
    hold, until there are none: a word beyond the margin is no part of the squared
    hinge's gradient, so the machine is that of all everyday words, and memory is
    needed for the ones near its margin only.
    """
    project = lambda strings: [(marks.kernel(strings[i : i + BLOCK]) @ to).astype(np.float32) for i in range(0, len(strings), BLOCK)]
    blocks = project(list(times))
    strong = np.array([min(n, 20) for n in times.values()], float)
    strong *= COST * 200 / strong.sum()
    taken, more, count = np.zeros(len(everyday), bool), np.arange(min(BLOCK, len(everyday))), 0
    while True:
        taken[more] = True
        count += len(more)
        blocks += project([everyday[i] for i in more.tolist()])
        w = _machine(blocks, np.repeat([1.0, -1.0], [len(strong), count]), np.concatenate([strong, np.full(count, CLEAN_COST)]))
        scorer = Scorer(marks.folded(to @ w[:-1]), float(w[-1]))
        value = _values(scorer, everyday)
        more = np.flatnonzero(~taken & (value > -1))
        if not len(more):
            return scorer, value


def _telling(toxic: list[list[bytes]], clean: list[list[bytes]]) -> list[bytes]:
    """Words met in so many toxic texts, near copies counted once, and so few clean ones that chance explains none of them."""
    pos, neg = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    sets = [frozenset(b) for b in toxic]
    holds = defaultdict(list)
    for d, b in enumerate(toxic):
        for w in b:
            if len(w) > 2 and 20 * neg[w] * len(toxic) <= pos[w] * max(1, len(clean)):
                holds[w].append(d)
    share = len(toxic) / (len(toxic) + len(clean) + 1)
    need = np.log(0.05 / max(1, len(pos))) / np.log(share) if share > 0 else np.inf
    out = []
    for w, ds in holds.items():
        if len(ds) >= need:
            apart: list[int] = []
            for d in ds:
                if all(2 * len(sets[d] & sets[e]) < min(len(sets[d]), len(sets[e])) for e in apart):
                    apart.append(d)
                if len(apart) >= need:
                    out.append(w)
                    break
    return sorted(out, key=lambda w: (-pos[w], w))


def _seeds(toxic: list[list[bytes]], clean: list[list[bytes]]) -> Counter:
    """Words that account for toxic texts: greedily the one that covers most of those not covered yet, nearly absent from clean ones."""
    pos, neg = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    fair = {w for w, p in pos.items() if len(w) > 2 and p >= 2 and 20 * neg[w] * len(toxic) <= p * max(1, len(clean))}
    holds = defaultdict(set)
    for d, b in enumerate(toxic):
        for w in b:
            if w in fair:
                holds[w].add(d)
    left, out = set(range(len(toxic))), Counter()
    # what a word covers only falls, so the first of the heap whose number is still right is the best
    heap = [(-len(holds[w]), -pos[w], i, w) for i, w in enumerate(sorted(holds, reverse=True))]
    heapq.heapify(heap)
    while heap and heap[0][0] <= -2:
        covered, p, i, w = heap[0]
        now = len(holds[w] & left)
        if now != -covered:
            heapq.heapreplace(heap, (-now, p, i, w))
            continue
        heapq.heappop(heap)
        out[w] = now
        left -= holds[w]
    return out


def fit(rows: list[tuple[str, int]], clean_odds: float = 1.0) -> Scorer:
    """Train on (text, label) rows; ``clean_odds`` is how many clean texts each sampled clean row stands for.

    Texts are bags: greedy covering proposes each bag's toxic word, then rounds
    of training and choosing again settle it; clean texts give all their words.
    Landmarks are telling words, chosen ones, everyday ones and the worst-scored
    everyday ones. Every fifth text is kept for calibration.
    Without both labels the scorer gives every text the share of toxic labels.
    """
    seen, unique = set(), []
    for text, label in rows:
        key = (zlib.crc32(text.encode()), len(text), label)
        if text and key not in seen:
            seen.add(key)
            unique.append((text, label))
    bag = bags([t for t, _ in unique])
    label = [y for _, y in unique]
    train = [i for i in range(len(unique)) if i % 5]
    toxic, clean = [bag[i] for i in train if label[i] == 1], [bag[i] for i in train if label[i] == 0]
    seeds = _seeds(toxic, clean)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    telling = _telling(toxic, clean)
    if not (seeds or telling) or not clean:
        return Scorer(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = lambda ws: sorted(ws, key=lambda w: (zlib.crc32(w), w))
    everyday = order({w for b in clean for w in b if w})
    if not everyday:
        return Scorer(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    words = sorted({x for b in toxic for x in b if x})
    chosen = [*seeds, *telling]
    hard: list[bytes] = []
    for _ in range(ROUNDS):
        marks = Landmarks(list(dict.fromkeys([*telling[: LANDMARKS // 2], *order(set(chosen))[:LANDMARKS], *hard, *everyday[:LANDMARKS]])))
        vals, vecs = np.linalg.eigh(marks.gram())
        keep = vals > 1e-4 * vals.max()
        machine, value = _settled(marks, vecs[:, keep] / np.sqrt(vals[keep]), Counter(chosen + telling * 3), everyday)
        of = dict(zip(words, _values(machine, words).tolist(), strict=True))
        chosen = [best for b in toxic if (best := max((x for x in b if x), key=lambda x: (of[x], x), default=None)) is not None and of[best] > -0.3]
        if not chosen and not telling:
            break
        hard = [everyday[i] for i in np.argsort(-value, kind="stable")[: LANDMARKS // 2].tolist()]
    held = [i for i in range(len(unique)) if i % 5 == 0]
    margin = np.maximum(machine.texts(pa.array([unique[i][0] for i in held], pa.string())), -3.0)
    y = np.array([label[i] for i in held], float)
    slope, shift = _calibrate(margin, y, np.where(y == 1, 1.0, clean_odds))
    return Scorer(machine.table, machine.bias, slope, shift)


def _packed(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    end = np.cumsum(list(map(len, strings)))
    return np.frombuffer(b"".join(strings), np.uint8), end - list(map(len, strings)), end


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, slightly regularised; the slope never falls below a half."""
    if not len(x):
        return 2.0, 0.0
    w = np.array([2.0, 0.0])
    z = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.05, 0.01])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - np.array([0.05, 0.01]) * (w - [4.0, 0.0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.5), float(w[1])


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled documents of folds 0 and 2: a bounded sample, by hash of the id.

    The ids of the sample (TOXIC_ROWS + CLEAN_ROWS at most) are broadcast to the
    scan of the documents, so the training reads all texts but shuffles only the
    sample. Of documents that repeat an id the least text is taken; an id with
    both labels gives a row of each; null ids or labels, empty texts and texts
    over LONGEST characters take no part; without rows of both labels, as with
    empty tables, every text scores the share of toxic labels, or a half.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 1).distinct()
    count = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    ids = usable.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TOXIC_ROWS).unionByName(usable.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLEAN_ROWS))
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, LONGEST))
    sample = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        taken = max(1, sum(r[2] == 0 for r in rows)) / max(1, sum(r[2] == 1 for r in rows))
        s = fit([(t, y) for _, t, y in rows], clean_odds=max(1.0, count.get(0, 0) / max(1, count.get(1, 0)) / taken))
        yield pa.RecordBatch.from_arrays([pa.array([s.table.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (s.bias, s.slope, s.shift))], names=["t", "bias", "slope", "shift"])

    # the bounded sample is fitted in one task, so the driver gets the machine alone
    got = sample.select("doc_id", "text", "toxic").repartition(1).mapInArrow(tidy(run), "t binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([])
    return Scorer(np.frombuffer(got[0][0], np.float32), *got[0][1:])


def toxicity(documents: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of each row's whole text.

    One pass, no shuffle. A null or empty text scores as one without a toxic
    word; repeated rows give a row each; an empty table gives none; other
    columns are ignored.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = scorer.score(scorer.texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return src.mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they are; cases as in ``toxicity``."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(scorer.score(scorer.texts(part.column(at))) < threshold))

    return documents.mapInArrow(tidy(run), documents.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; cases as in ``toxicity``, a null id isn't held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
