"""Logistic mixing of predictors over the running text, for ``lm_scoring``.

A token stands in the text by its code, CODE bits of its hash. The bits are
predicted one after the other, each from: the bit's share in the tokens' own
probabilities; counts in the context of the word before and of the two words
before, hashed into tables, over the whole training stream; what followed the
same two words earlier in the text. A gate selects the weights of the mixture by
how much each of these has to say, and an adaptive map refines the result.

A training text is predicted without its own occurrence: its bits are taken out
of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, mix, slices, tidy

#: Bits of a token's code, and of the tables of the two contexts before it.
CODE, FOLLOW = 12, (20, 21)
#: Count added to either side of a bit.
PRIOR = 0.4
#: Shares of the training texts, in sixteenths, after which the weights are moved: each Newton step reads other texts.
ROUNDS = ((0, 1), (1, 3), (3, 7), (7, 16))
#: Tokens that are worked on at once and bytes of text of a slice, so that all arrays stay in a core's cache.
BLOCK, SLICE = 4_096, 1 << 19
#: Bits of a code whose slots lie side by side; divides CODE.
NEAR = 4
#: Tokens after which a task hands on its tables: their counts are 32-bit.
FLUSH = 1 << 30
#: Probabilities of the refined mixture are told at so many points for each unit of log-odds.
FINE = 128
#: Steps of the adaptive map and what the identity weighs in it; slots of a chunk when tables are added up.
STEPS, IDENTITY, CHUNK = 33, 50.0, 1 << 14
#: Most weight of the text's own tokens so far, and tokens after which it has half of that.
CACHE, CACHE_AT = 0.2, 50

INPUTS, GATES = 5, 24
END_HASH, _BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: What the constant input is; of gates as ``steps`` has them, the gate of the weights and what the match says.
CONSTANT = 0.3
_GATE_OF, _SAYS = np.r_[0:GATES, GATES // 2 : GATES], np.repeat([0.0, -1.0, 1.0], GATES // 2)
#: How often a slot was seen, in levels: of the first context three, of the second four.
_LEVELS = ((4, 64), (1, 2, 4))


class Stream:
    """All tokens of a slice of texts in order, each text followed by its end.

    ``ends[d]`` is the place of text d's end, ``owner`` each token's text,
    ``words`` the places of those that are words.
    """

    def __init__(self, w: Words):
        n = len(w)
        self.ends = w.first[1:] + np.arange(n)
        self.begin = w.first[:-1] + np.arange(n)
        self.owner = np.repeat(np.arange(n), np.diff(w.first) + 1)
        self.words = np.arange(len(w.hash)) + np.repeat(np.arange(n), np.diff(w.first))
        self.hash = np.full(len(self.owner), END_HASH)
        self.hash[self.words] = w.hash
        self.code = (self.hash >> np.uint64(64 - CODE)).astype(np.int32)
        first = np.zeros(len(self.hash), bool)
        first[self.begin] = True

        def before(x: np.ndarray) -> np.ndarray:
            out = np.roll(x, 1)
            out[first] = _BEGIN
            return out

        one = before(self.hash)
        self.contexts = [mix(one), mix(before(one) * _GOLD + one)]

    def last(self, key: np.ndarray) -> np.ndarray:
        """The last earlier place of each text with the same key, -1 where there is none."""
        key = key ^ (self.owner.astype(np.uint64) + np.uint64(1)) * _GOLD
        low = np.uint64(len(key).bit_length())
        packed = np.sort(key >> low << low | np.arange(len(key), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        same = key[order][1:] == key[order][:-1]
        if (same != (packed[1:] >> low == packed[:-1] >> low)).any():  # keys that differ in their lowest bits alone
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
        out = np.full(len(key), -1)
        out[order[1:][same]] = order[:-1][same]
        return out

    def earlier(self) -> np.ndarray:
        """How many tokens of the same code stand earlier in the text."""
        low = len(self.code).bit_length()
        at, new = np.arange(len(self.code)), np.ones(len(self.code), bool)
        packed = np.sort((self.owner << CODE | self.code) << low | at)
        new[1:] = np.diff(packed >> low) != 0
        out = np.empty(len(at), np.int64)
        out[packed & ((1 << low) - 1)] = at - np.maximum.accumulate(np.where(new, at, 0))
        return out


def node_slots(code: np.ndarray, contexts: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """NEAR bits of codes at a time: (their numbers; by code and bit the bit, the node of the code tree and what the node adds
    to a slot's place; by code a place in each table).

    Contexts are the upper halves of their hashes; a slot has 2 ** width numbers,
    and its first one is at the place ^ what the node adds. Nodes of the same
    NEAR bits are in the same 2 ** NEAR slots, so that memory is read once for
    all of them; each node of each context has a place of its own hash there.
    """
    own = 1 << np.arange(NEAR)
    for first in range(0, CODE, NEAR):
        k = np.arange(first, first + NEAR)
        node = code[:, None] >> (CODE - k) | 1 << k
        salt = node[:, 0].astype(np.uint32) * np.uint32(0x9E3779B1)
        starts = []
        for c, bits in zip(contexts, FOLLOW, strict=True):
            x = c ^ salt
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            x >>= np.uint32(32 - bits)
            starts.append((x.astype(np.intp) << width)[:, None])
        yield k, code[:, None] >> (CODE - 1 - k) & 1, node, (node & (own - 1) | own) << width, starts


def halves(contexts: list[np.ndarray]) -> list[np.ndarray]:
    return [(c >> np.uint64(32)).astype(np.uint32) for c in contexts]


def slim(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need."""
    top = x.max()
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    """n counts from ``slim``."""
    return np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n]).astype(np.int64)


# --- the mixture


def follow_tables(texts: DataFrame) -> list[np.ndarray]:
    """What is ``told`` of the codes' bits in both contexts by all texts that aren't held out: tables of fixed size, counted and added up in chunks."""

    def parts(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for j, t in enumerate(tables):
            for k in range(0, len(t), 2 * CHUNK):
                part = t[k : k + 2 * CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([k], pa.int32()), pa.array([slim(part)], pa.binary())], names=["t", "k", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [np.zeros(2 << n, np.int32) for n in FOLLOW], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Stream(Words(part.column(0), LOWER))
                contexts = halves(s.contexts)
                for a in range(0, len(s.code), BLOCK):
                    v = slice(a, a + BLOCK)
                    if n + BLOCK > FLUSH:
                        yield from parts(tables)
                        tables, n = [np.zeros_like(t) for t in tables], 0
                    n += BLOCK
                    for _, bit, _, own, starts in node_slots(s.code[v].astype(np.intp), [c[v] for c in contexts], 1):
                        for t, start in zip(tables, starts, strict=True):
                            np.add.at(t, (start ^ (own | bit)).reshape(-1), np.int32(1))
        yield from parts(tables)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for j, k, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = wide(part, 2 * CHUNK)
                sums[j, k] = sums[j, k] + x if (j, k) in sums else x
        for (j, k), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([2 * k], pa.int32()), pa.array([told(x.reshape(-1, 2), _LEVELS[j]).tobytes()], pa.binary())], names=["t", "k", "part"])

    schema = "t int, k int, part binary"
    cores = max(1, texts.sparkSession.sparkContext.defaultParallelism)
    found = texts.where("NOT held").select("text").coalesce(cores).mapInArrow(tidy(run), schema).repartition("t", "k").mapInArrow(tidy(add), schema).toArrow()
    tables = [np.zeros(4 << n, np.int16) for n in FOLLOW]
    for j, k, part in zip(*(found.column(c).to_pylist() for c in ("t", "k", "part")), strict=True):
        x = np.frombuffer(part, np.int16)
        tables[j][k : k + len(x)] = x
    return tables


def told(counts: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """What slots say of (n0, n1), as numbers: log-odds in 1/256 above two bits of how often they were seen; of all
    occurrences, without one of a 0, and without one of a 1. The fourth number of a slot is empty."""
    out = np.zeros((len(counts), 4), np.int16)
    for i, one in enumerate(([0, 0], [1, 0], [0, 1])):
        n = (counts - np.array(one)).clip(0)
        odds = np.rint(256 * np.clip(np.log(n[:, 1] + PRIOR) - np.log(n[:, 0] + PRIOR), -12, 12))
        out[:, i] = odds * 4 + np.searchsorted(levels, n.sum(axis=1), "right")
    return out.reshape(-1)


class CodeMixer:
    """Predicts the codes of a stream from what slots say (``told``). ``mass`` is what the codes have without any context."""

    def __init__(self, tables: list[np.ndarray], mass: np.ndarray, weights: np.ndarray | None = None, hits: np.ndarray | None = None):
        self.tables = tables
        tree = np.concatenate([np.zeros(len(mass)), mass])
        for i in range(len(mass) - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        one = np.clip(tree[1::2] / np.maximum(tree[1::2] + tree[::2], 1e-300), 1e-9, 1 - 1e-9)  # share of the right side below each node
        self.plain = np.clip(np.log(one / (1 - one)), -12, 12).astype(np.float32)
        self.weights = np.tile(np.array([0.6, 0.3, 0.3, 0.3, 0.0]), (GATES, 1)) if weights is None else weights
        self.hits = np.zeros((2, GATES * STEPS)) if hits is None else hits
        # by gate and what a match says, as steps() has it: weights of the other inputs, and what the match and the constant add
        w = self.weights[_GATE_OF]
        self.by_gate = [np.ascontiguousarray(x, np.float32) for x in (w[:, 0], w[:, 1] / 256, w[:, 2] / 256, w[:, 3] * _SAYS + w[:, 4] * CONSTANT)]
        self.fine: np.ndarray | None = None

    def steps(self, s: Stream, held: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, the bit, share's log-odds, both contexts' in 1/256, gate) for BLOCK tokens and NEAR bits of their codes at a time.

        The gate is one of 3 * GATES / 2: without a match, with one that says 0, with one that says 1.
        """
        prev = s.last(s.contexts[1])
        match = np.where(prev >= 0, s.code[prev], np.int32(-1))
        own = (~held[s.owner]).astype(np.intp)  # the token's own occurrence is in the tables
        contexts = halves(s.contexts)
        for a in range(0, len(s.code), BLOCK):
            v = slice(a, min(len(s.code), a + BLOCK))
            code, without = s.code[v].astype(np.intp), own[v]
            on = np.flatnonzero(match[v] >= 0)
            e, c = match[v][on], s.code[v][on]
            for k, bit, node, place, starts in node_slots(code, [c[v] for c in contexts], 2):
                place |= without[:, None] * (1 + bit)
                first, second = (t.take(start ^ place, mode="clip").reshape(-1) for t, start in zip(self.tables, starts, strict=True))
                gate = (first & 3) << 2 | second & 3
                if len(on):
                    fits = e[:, None] >> (CODE - k) == c[:, None] >> (CODE - k)
                    gate.reshape(-1, NEAR)[on] += (fits * (GATES // 2 * (1 + (e[:, None] >> (CODE - 1 - k) & 1)))).astype(np.int16)
                yield v, bit.reshape(-1), self.plain.take(node, mode="clip").reshape(-1), first >> 2, second >> 2, gate

    def refined(self) -> np.ndarray:
        """The probability of a 1 for each gate at FINE points for each unit of the mixed log-odds: the mean of what these say and
        what bits of such odds turned out to be."""
        t = np.arange(-12 * FINE, 12 * FINE + 1) / FINE
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) * 16 / (STEPS - 1) - 8)))
        seen, ones = self.hits.reshape(2, GATES, STEPS)
        odds = (ones + IDENTITY * centre) / (seen + IDENTITY)
        u = (np.clip(t, -8, 8) + 8) * (STEPS - 1) / 16
        turned = np.stack([np.interp(u, np.arange(STEPS), x) for x in odds])
        return np.clip((1 / (1 + np.exp(-t)) + turned) / 2, 1e-6, 1 - 1e-6)[_GATE_OF].astype(np.float32).reshape(-1)

    def lessons(self, s: Stream, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gradient, curvature, hits of the map) of all bits of all tokens of texts none of which is held out, at these weights."""
        kinds = len(_GATE_OF)
        # sums by gate and what a match says, over the first three inputs and a 1
        grad, curve, hits = np.zeros((kinds, 4)), np.zeros((kinds, 4, 4)), np.zeros(kinds * STEPS * 2, np.int64)
        for _, bit, plain, first, second, gate in self.steps(s, held):
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            size = np.bincount(gate, minlength=kinds)
            x = np.ones((4, len(order)), np.float32)
            plain.take(order, out=x[0], mode="clip")
            x[1], x[2], bit = first.take(order, mode="clip"), second.take(order, mode="clip"), bit.take(order, mode="clip")
            t = np.repeat(self.by_gate[3], size)
            for w, row in zip(self.by_gate, x[:3], strict=False):
                w = np.repeat(w, size)
                w *= row
                t += w
            np.clip(t, -12, 12, out=t)
            q = np.exp(-t)
            q += 1
            np.reciprocal(q, out=q)
            err = bit.astype(np.float32)
            err -= q
            q *= 1 - q
            weighed = x * q
            edge = np.cumsum(size)
            for g in np.flatnonzero(size).tolist():
                a, b = edge[g] - size[g], edge[g]
                grad[g] += x[:, a:b] @ err[a:b]
                curve[g] += weighed[:, a:b] @ x[:, a:b].T
            np.clip(t, -8, 8, out=t)
            t += 8
            t *= (STEPS - 1) / 16
            np.rint(t, out=t)
            i = t.astype(np.intp)
            i += np.repeat(np.arange(kinds) * STEPS, size)
            hits += np.bincount(2 * i + bit, minlength=len(hits))
        # the contexts' odds are in 1/256, the match says the same within a kind
        unit = np.zeros((kinds, INPUTS, 4))
        unit[:, 0, 0] = 1
        unit[:, 1, 1] = unit[:, 2, 2] = 1 / 256
        unit[:, 3, 3], unit[:, 4, 3] = _SAYS, CONSTANT
        by_gate = [np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS)), np.zeros((GATES, STEPS, 2), np.int64)]
        for total, x in zip(by_gate, (np.einsum("gij,gj->gi", unit, grad), unit @ curve @ unit.transpose(0, 2, 1), hits.reshape(kinds, STEPS, 2)), strict=True):
            np.add.at(total, _GATE_OF, x)
        zeros, ones = by_gate[2].reshape(-1, 2).T
        return by_gate[0], by_gate[1], np.stack([zeros + ones, ones]).astype(float)

    def moved(self, grad: np.ndarray, curve: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, hits of the map) after a Newton step, drawn to where the weights are."""
        step = np.linalg.solve(curve + 20 * np.eye(INPUTS), grad[:, :, None])[:, :, 0]
        return self.weights + np.clip(step, -1, 1), self.hits + hits

    def log10(self, s: Stream, held: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's code: the mixture, and beside it the share of the code in the text so far."""
        whole = np.ones(len(s.code))
        if self.fine is None:
            self.fine = self.refined()
        for v, bit, plain, first, second, gate in self.steps(s, held):
            gate = gate.astype(np.intp)
            t = self.by_gate[3].take(gate, mode="clip")
            for w, x in zip(self.by_gate, (plain, first, second), strict=False):
                w = w.take(gate, mode="clip")
                w *= x
                t += w
            t *= FINE
            t += np.float32(12 * FINE + 0.5)
            np.clip(t, 0, 24 * FINE, out=t)
            gate *= 24 * FINE + 1
            gate += t.astype(np.intp)
            p = self.fine.take(gate, mode="clip")
            p -= (1 - bit).astype(np.float32)
            whole[v] *= np.abs(p, out=p).reshape(-1, NEAR).prod(axis=1)
        t = np.arange(len(s.code)) - s.begin[s.owner]
        part = CACHE * t / (t + CACHE_AT)
        return np.log10((1 - part) * whole + part * s.earlier() / np.maximum(t, 1))


def share(key: Column) -> Column:
    """Which sixteenth of the texts one belongs to."""
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(16))


def learn(texts: DataFrame, tables, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, hits of the map), learned online over all training texts; ``tables`` is broadcast.

    The texts come in the fixed shares of ROUNDS, by the hash of their key; each
    share moves the weights once, by sums over all its tokens, so neither cores
    nor partitions change the result.
    """
    spark = texts.sparkSession
    mixer = CodeMixer(tables.value, mass)
    sizes = (GATES * INPUTS, GATES * INPUTS * INPUTS, 2 * GATES * STEPS)
    for first, last in ROUNDS:
        state = spark.sparkContext.broadcast((mass, mixer.weights, mixer.hits))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own, values = CodeMixer(tables.value, *state.value), np.zeros(sum(sizes))
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    values += np.concatenate([a.reshape(-1) for a in own.lessons(Stream(Words(part.column(0), LOWER)), np.zeros(part.num_rows, bool))])
            on = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(values[on])], names=["i", "x"])

        some = texts.where(~F.col("held") & share(F.col("key")).between(first, last - 1)).select("text")
        sums = some.mapInArrow(tidy(run), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        values = np.zeros(sum(sizes))
        values[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        grad, curve, hits = np.split(values, np.cumsum(sizes)[:-1])
        mixer = CodeMixer(tables.value, mass, *mixer.moved(grad.reshape(GATES, INPUTS), curve.reshape(GATES, INPUTS, INPUTS), hits.reshape(2, -1)))
        state.unpersist()
    return mixer.weights, mixer.hits
