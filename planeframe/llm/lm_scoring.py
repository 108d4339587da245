"""Language-model scores: online logistic mixing of hashed-context bit predictors.

A text is a stream of tokens, its words and an end. A token's code, some bits of
its hash, is predicted bit by bit from what stands before it, by the mixture of
``lm_context``: over the running text, across words. Which of the tokens of one
code it is says its own probability, which knows no context: its discounted
count in the training texts, and for what the discounts leave its spelling.

A token is spelled by its bytes and a terminator, eight binary decisions each,
the end of a text by a byte of its own. Five predictors give each bit's odds
from counts of bits seen in their context (position; the last one, two, three
bytes; the whole word so far), hashed into tables. A mixer adds their log-odds
under weights that a gate selects and that are learned online; an adaptive map
refines the sum. That depends on the token alone, so each distinct token is
spelled once.

All probabilities of a token at its place add up to one, whatever collides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Index, Words, cut, slices, tidy
from .lm_context import CODE, END_HASH, CodeMixer, Stream, follow_tables, slim, wide
from .lm_context import learn as learn_context

#: Most frequent tokens whose counts and scores are broadcast; the others are joined.
FREQUENT = 1 << 18
#: Bits of the tables of the five contexts, and counts added to either side of a prediction.
TABLES, PRIOR = (10, 16, 18, 19, 20), (0.4, 0.4, 0.2, 0.1, 0.05)
#: Bytes of a token that are spelled in one row; a longer token goes on in further rows that know its last bytes.
PIECE = 32
#: Learning rate of the mixer, steps of the adaptive map, slots of a chunk when tables are added up.
RATE, STEPS, CHUNK = 0.03, 33, 1 << 14
#: Tokens that the mixer works on at once.
CHUNK_ROWS = 200_000
#: The end of a text, as a token that no word equals.
END = b"\0 "

_GATES = 18
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


class Spelling:
    """Tokens cut into rows of at most PIECE bytes, the longest first."""

    def __init__(self, tokens: list[bytes]):
        owner, rows, before, last = [], [], [], []
        for i, t in enumerate(tokens):
            if t == END:
                owner.append(i), rows.append(b"\0"), before.append(b"\0\0\0"), last.append(True)
                continue
            t = t + b" "
            for a in range(0, len(t), PIECE):
                owner.append(i), rows.append(t[a : a + PIECE]), before.append((b"\0\0\0" + t[max(0, a - 3) : a])[-3:]), last.append(a + PIECE >= len(t))
        self.owner = np.array(owner, np.int64)
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self.before = np.frombuffer(b"".join(before), np.uint8).reshape(-1, 3)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For every bit position: (rows, the bit, the slot in each table).

        The slots of four bits of a byte lie side by side in the large tables, so that memory is read once for all of them.
        """
        order = np.argsort(-self.size, kind="stable")
        for at in range(0, len(order), 30_000):
            rows = order[at : at + 30_000]
            size = self.size[rows]
            hist = [self.before[rows, 2 - j].astype(np.uint32) for j in range(3)]
            prefix = hist[0] * _MUL[0] + hist[1] * _MUL[1] + np.uint32(7)
            for i in range(size[0]):
                live = int(np.searchsorted(-size, -i))
                r, hist, prefix = rows[:live], [h[:live] for h in hist], prefix[:live]
                s = self.data[self.first[r] + i].astype(np.uint32)
                byte = s.astype(np.intp)
                place, one = np.intp(min(i, 3) << 8), hist[0].astype(np.intp) << 8
                two = (hist[0] * _MUL[0] ^ hist[1]) * _MUL[1]
                three = (two ^ hist[2]) * _MUL[2] + np.uint32(1)
                starts: list[np.ndarray] = []
                for k in range(8):
                    node = byte >> (8 - k) | 1 << k
                    if k % 4 == 0:
                        salt, starts = node.astype(np.uint32) * _MUL[3], []
                        for h, bits in zip((two, three, prefix), TABLES[2:], strict=True):
                            x = (h ^ salt) * _MUL[0]
                            x ^= x >> np.uint32(15)
                            x *= _MUL[2]
                            starts.append((x >> np.uint32(32 - bits)).astype(np.intp))
                    own = node & ((1 << k % 4) - 1) | 1 << k % 4
                    yield r, byte >> (7 - k) & 1, [place | node, one | node, *(x ^ own for x in starts)]
                prefix = (prefix ^ s) * _MUL[1] + _MUL[2]
                prefix ^= prefix >> np.uint32(13)
                hist = [s, hist[0], hist[1]]


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _odds(table: np.ndarray, prior: float) -> np.ndarray:
    """Four numbers a slot: of all occurrences, without one of a 0, without one of a 1, and none; log-odds in 1/256 above three bits
    of how much was seen, from 0 to 5."""
    out = np.zeros((len(table), 4), np.int16)
    for i, one in enumerate(([0, 0], [1, 0], [0, 1])):
        n = table - np.array(one, np.float32)
        log = np.log(np.maximum(n, 0) + np.float32(prior))
        odds = np.rint(256 * np.clip(log[:, 1] - log[:, 0], -12, 12)).astype(np.int16)
        out[:, i] = odds * 8 + np.searchsorted(np.array([0.5, 1.5, 16, 64, 256], np.float32), n.sum(axis=1), "left").astype(np.int16)
    return out.reshape(-1)


class Mixer:
    """Tables of counts (n0, n1 per slot), weights per gate, and the adaptive map."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, hits: np.ndarray | None = None):
        self.tables = tables
        self.weights = np.tile(np.array([0.0, 0.1, 0.2, 0.3, 0.4, 0.0]), (_GATES, 1)) if weights is None else weights
        self.hits = np.zeros((2, _GATES * STEPS)) if hits is None else hits
        self.ready: list | None = None
        self.told: np.ndarray | None = None
        self.seen = np.zeros_like(self.weights)  # squared gradients so far: steps shrink with them

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds by predictor and a constant, gate). With ``bit``, one occurrence of it, the token's own, is taken out of the counts."""
        if self.ready is None:
            self.ready = [_odds(t, p) for t, p in zip(self.tables, PRIOR, strict=True)]
        x = np.empty((len(slots) + 1, len(slots[0])), np.float32)
        which = 0 if bit is None else 1 + bit
        for j, t in enumerate(self.ready):
            told = t.take(slots[j] << 2 | which, mode="clip")
            np.multiply(told >> 3, np.float32(1 / 256), out=x[j])
            if j == 3:
                three = told & 7
        x[-1] = 0.3
        return x, ((told & 7) * 3 + np.minimum(three, 2)).astype(np.intp)

    def logit(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights.T.astype(np.float32)
        t = w[0].take(gate, mode="clip")
        t *= x[0]
        for j in range(1, len(x)):
            more = w[j].take(gate, mode="clip")
            more *= x[j]
            t += more
        return np.clip(t, -14, 14, out=t)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x, gate).astype(np.float64)))

    def refine(self, p: np.ndarray, gate: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        """The mean of the mixed probability (whose log-odds may be given) and what bits of such probability turned out to be."""
        if self.told is None:
            self.told = self._map().astype(np.float32)
        t = np.clip(_stretch(p) if odds is None else odds, -8, 8)
        t += 8
        t *= (STEPS - 1) / 16
        lo = np.minimum(t.astype(np.intp), STEPS - 2)
        t -= lo.astype(np.float32)
        lo += gate * STEPS
        low, high = self.told.take(lo, mode="clip"), self.told.take(lo + 1, mode="clip")
        return np.clip((p + low + (high - low) * t) / 2, 1e-7, 1 - 1e-7)

    def _map(self) -> np.ndarray:
        centre = np.tile(1 / (1 + np.exp(-(np.arange(STEPS) * 16 / (STEPS - 1) - 8))), _GATES)
        return (self.hits[1] + 50 * centre) / (self.hits[0] + 50)

    def learn(self, spelling: Spelling, count: np.ndarray) -> None:
        """One online pass: predict each bit without the token's own occurrence, then move the weights and the map."""
        seen = self.seen
        for r, bit, slots in spelling.steps():
            c = count[spelling.owner[r]]
            x, gate = self.inputs(slots, bit)
            odds = self.logit(x, gate).astype(np.float64)
            err = (bit - 1 / (1 + np.exp(-odds))) * c
            for j in range(len(x)):
                g = np.bincount(gate, err * x[j], _GATES)
                seen[:, j] += g * g
                self.weights[:, j] += RATE * g / np.sqrt(seen[:, j] + 1e-9)
            t = np.rint((np.clip(odds, -8, 8) + 8) * (STEPS - 1) / 16).astype(np.intp)
            t += gate * STEPS
            n = np.bincount(2 * t + bit, c, 2 * _GATES * STEPS).reshape(-1, 2)
            self.hits += (n[:, 0] + n[:, 1], n[:, 1])
        self.told = None

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 of each token's probability."""
        s = Spelling(tokens)
        out, byte = np.zeros(len(s.owner)), 1.0
        for k, (r, bit, slots) in enumerate(s.steps()):
            x, gate = self.inputs(slots)
            t = self.logit(x, gate)
            p = self.refine(1 / (1 + np.exp(-t)), gate, t)
            byte = byte * np.abs((1 - bit) - p)
            if k % 8 == 7:
                out[r] += np.log10(byte)
                byte = 1.0
        return np.bincount(s.owner, out, len(tokens)) if len(tokens) else out


def _unique(words: Words, owner: np.ndarray | None, keep: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, owner, times) of the distinct words (of each owner) at the kept places."""
    at = np.flatnonzero(keep)
    h = words.hash[at]
    key = h if owner is None else h ^ (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    size = words.end[at] - words.start[at]
    off = np.concatenate([[0], np.cumsum(size)])
    data = words.data[np.arange(off[-1]) + np.repeat(words.start[at] - off[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)]), (owner[at] if owner is not None else at), n


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Join small batches: a step of the mixer costs as much for few tokens as for thousands."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def token_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c): all tokens of all texts with their counts in those that aren't held out; one END for each text.

    Counted within slices before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, some = 0, False
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                w = Words(part.column(0), LOWER)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                owner = np.repeat(held, np.diff(w.first))
                for keep, own in ((~owner, 1), (owner, 0)):
                    if keep.any():
                        word, _, n = _unique(w, None, keep)
                        yield pa.RecordBatch.from_arrays([word, pa.array(n * own, pa.int64())], names=["word", "c"])
                ends += int((~held).sum())
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return texts.select("text", "held").mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def context_tables(vocabulary: DataFrame) -> list[np.ndarray]:
    """Counts of bits in every context over the whole vocabulary: tables of fixed size, added up in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in chunks(batches):
            tables = tables or [np.zeros(2 << n) for n in TABLES]
            s, c = Spelling(b.column(0).to_pylist()), b.column(1).to_numpy().astype(np.float64)
            for r, bit, slots in s.steps():
                w = c[s.owner[r]]
                for t, at in zip(tables, slots, strict=True):
                    np.add.at(t, 2 * at + bit, w)
        for j, t in enumerate(tables or []):
            for k in range(0, len(t) // 2, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([k], pa.int32()), pa.array([slim(t[2 * k : 2 * (k + CHUNK)])], pa.binary())], names=["t", "k", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for j, k, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = wide(part, 2 * min(CHUNK, 1 << TABLES[j])).astype(np.float64)
                sums[j, k] = sums[j, k] + x if (j, k) in sums else x
        for (j, k), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["t", "k", "part"])

    schema = "t int, k int, part binary"
    cores = max(1, vocabulary.sparkSession.sparkContext.defaultParallelism)
    found = vocabulary.where("c > 0").select("word", "c").coalesce(cores).mapInArrow(tidy(run), schema).repartition("t", "k").mapInArrow(tidy(add), schema).collect()
    tables = [np.zeros((1 << n, 2), np.float32) for n in TABLES]
    for j, k, part in found:
        x = np.frombuffer(part, np.float32).reshape(-1, 2)
        tables[j][k : k + len(x)] = x
    return tables


def learn(vocabulary: DataFrame, shared, units: int) -> Mixer:
    """Weights and adaptive map, learned online over each ``units``-th part of the whole vocabulary, by hash and in the order of words, and then averaged by token mass; ``shared`` are the tables, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mass = Mixer(shared.value), 0.0
        for b in chunks(batches):
            c = b.column(1).to_numpy().astype(np.float64)
            m.learn(Spelling(b.column(0).to_pylist()), c)
            mass += float(np.sqrt(c).sum())
        if mass:
            values = np.concatenate([m.weights.reshape(-1) * mass, m.hits.reshape(-1), [mass]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "x"])

    got = {r[0]: r[1] for r in vocabulary.where("c > 0").select("word", "c").repartition(units, "word").sortWithinPartitions("word").mapInArrow(tidy(run), "i int, x double").groupBy("i").agg(F.sum("x")).collect()}
    if not got:
        return Mixer(shared.value)
    values = np.array([got[i] for i in range(len(got))])
    n = _GATES * (len(TABLES) + 1)
    return Mixer(shared.value, values[:n].reshape(_GATES, -1) / values[-1], values[n:-1].reshape(2, -1))


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text is divisible by ten; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row's whole text.

    Learns from the rows that aren't held out. ``base_score`` is the smoothed
    unigram's log10 probability, ``score`` the mixing model's, for a training
    text without its own occurrence in the contexts' counts; ``bits_per_byte`` is
    the latter in bits over the bytes of the tokens and one for each (null
    without a byte). The ``frequent`` most frequent tokens are broadcast
    (bounded); the other tokens of each text are joined with the vocabulary,
    which holds the tokens of all texts: the same number for the same token,
    whichever way it comes. A null text counts as empty and is its end alone; rows that
    repeat are trained on and returned each; an empty table gives no rows; with
    nothing to learn from, every token has the prior's probability; other
    columns are ignored.
    """
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"), held_out(documents[id_col]).alias("held"))
    src = src.withColumn("key", F.xxhash64("text"))
    broadcast = documents.sparkSession.sparkContext.broadcast
    counted = cut(token_counts(src))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    units = max(1, -(-total[2] // CHUNK_ROWS))
    counted = counted.coalesce(units)
    n_train, floor = int(total[0]), total[0] + 0.1 * (total[1] + 1)
    # a token's own count predicts it, less a discount; what the discounts leave goes to the spelling
    discount = total[3] / (total[3] + 2 * total[4]) if total[3] else 0.5
    rest = discount * total[1] / n_train if n_train else 1.0
    shared = broadcast(context_tables(counted))
    mixer = learn(counted, shared, units)
    weights, hits = mixer.weights, mixer.hits

    def with_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixer(shared.value, weights, hits)
        for b in chunks(batches):
            own = np.maximum(b.column(1).to_numpy() - discount, 0) / max(1, n_train)
            words = b.column(0).to_pylist()
            h = np.where([x == END for x in words], END_HASH, Words(b.column(0).cast(pa.string())).hash)
            code = pa.array((h >> np.uint64(64 - CODE)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.log10(own + rest * 10.0 ** m.log10(words) + 1e-300)), code], names=["word", "c", "lp", "code"])

    scored = cut(counted.mapInArrow(tidy(with_score), "word binary, c long, lp double, code int"))
    mass = np.zeros(1 << CODE)
    for code, x in scored.groupBy("code").agg(F.sum(F.pow(F.lit(10.0), "lp"))).collect():
        mass[code] = x
    mass += max(1 - mass.sum(), 1e-9) / len(mass)  # tokens that no text has
    tables = broadcast(follow_tables(src))
    state = broadcast((mass, *learn_context(src, tables, mass)))
    # from here on lp is a token's probability among those of its code
    of_code = documents.sparkSession.createDataFrame([(i, float(np.log10(x))) for i, x in enumerate(mass)], "code int, whole double")
    vocabulary = scored.join(F.broadcast(of_code), "code").select("word", "c", (F.col("lp") - F.col("whole")).alias("lp"))
    top = vocabulary.where("c > 0").orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    end_known = n_train > 0
    end_c = counted.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = (top.column("word").combine_chunks(), top.column("c").to_numpy(), top.column("lp").to_numpy())
    known = broadcast(head)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, lp = known.value
        own = Words(words.cast(pa.string())) if len(words) else None
        index = Index(max(8, (len(words) + 1).bit_length() + 1))
        if own is not None:
            plain = np.flatnonzero(np.diff(own.first) == 1)  # END is two bytes that are no single word of a text
            plain = plain[[w != END for w in words.take(pa.array(plain)).to_pylist()]]
            index.add(own.hash[own.first[plain]])
            count, lp = count[plain], lp[plain]
        model = CodeMixer(tables.value, *state.value)
        end_lp = np.log10(max(end_c - discount, 0) / max(1, n_train) + rest * 10.0 ** Mixer(shared.value, weights, hits).log10([END])[0]) - np.log10(state.value[0][int(END_HASH >> np.uint64(64 - CODE))])
        base = np.log10((count + 0.1) / floor)
        end_base = np.log10((end_c + 0.1) / floor)
        for part in (part for batch in batches for part in slices(batch, "text")):
            w = Words(part.column(1), LOWER)
            s, n = Stream(w), len(w)
            owner = np.repeat(np.arange(n), np.diff(w.first))
            code = index.get(w.hash)
            hit = code >= 0
            who, place = owner[hit], code[hit]
            sums = np.bincount(s.owner, model.log10(s, part.column(2).to_numpy(zero_copy_only=False).astype(bool)), n) + np.bincount(who, lp[place], n) + end_lp
            size = np.bincount(owner, w.end - w.start + 1, n).astype(np.int64)
            ids, mark = part.column(0), part.column(3)
            key = pa.array([f"{d} {m}".encode() for d, m in zip(ids.to_pylist(), mark.to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, mark, part.column(2), key, pa.array(np.zeros(n, np.int64)), pa.array(np.diff(w.first) + 1, pa.int64()), pa.array(np.bincount(who, minlength=n) + int(end_known), pa.int64()),
                 pa.array(np.bincount(who, base[place], n) + end_base), pa.array(sums), pa.array(size)],
                names=NAMES,
            )
            word, who, times = _unique(w, owner, ~hit)
            none, void = pa.array(np.zeros(len(who), np.int64)), pa.array(np.zeros(len(who)))
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays([ids.take(who), mark.take(who), part.column(2).take(who), word, pa.array(times, pa.int64()), none, none, void, void, none], names=NAMES)

    rows = src.select("doc_id", "text", "held", "key").mapInArrow(tidy(score), ROWS).join(vocabulary, "word", "left")

    # a row is a text with its frequent tokens, or one of its other tokens: every token is in the vocabulary
    tf, c = F.col("tf"), F.coalesce("c", F.lit(0))
    parts = rows.select(
        "doc_id", "mark", "held", (tf == 0).cast("long").alias("copies"), "n_tokens", (F.col("n_known") + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(tf > 0, tf * F.log10((c + 0.1) / F.lit(float(floor)))).otherwise(0.0)).alias("base"), (F.col("score") + F.when(tf > 0, tf * F.col("lp")).otherwise(0.0)).alias("score"), "size",
    )
    each = parts.groupBy("doc_id", "mark", "held").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score", "size")])
    each = each.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    return each.select(
        "doc_id", F.col("held").alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
        F.when(F.col("size") > 0, -F.col("score") / F.lit(np.log10(2.0).item()) / F.col("size")).alias("bits_per_byte"),
    )


ROWS = "doc_id long, mark long, held boolean, word binary, tf long, n_tokens long, n_known long, base double, score double, size long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``lm_scores``."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
