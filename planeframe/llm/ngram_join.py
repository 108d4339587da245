"""N-gram Jaccard self-join: near-duplicate classes by prefix filter and prefix trees.

Sets of n-gram hashes are ordered globally: rare n-grams by hash, those of a
heavy-hitter table last, by frequency. Documents with equal sets collapse into a
class first. Two sets that link share an n-gram among the first
n - ceil(t n) + 1 of each, so classes meet in the buckets of these n-grams; the
sets that a bucket proposes are held in a prefix tree, where one traversal
compares a set with all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, components, cut, distinct_keys, id_filter, ids_of, may_hold, slices, stored, tidy

#: Size of the heavy-hitter table. It only shapes the order of n-grams, so it changes cost, never results.
HEAVY = 1 << 18
#: N-grams a task holds before it condenses them into its summary, and how many it keeps.
SUMMARY, KEPT = 1_000_000, 1 << 17
#: Sets of one prefix tree, and size of a family from which its members are compared in blocks instead of pair by pair.
TREE, FAMILY = 128, 32

_LIGHT = np.uint64(2)
_TOP = np.int64(1) << np.int64(62)


class Order:
    """The global order: hash -> key; heavy n-grams come after all others."""

    def __init__(self, heavy: np.ndarray, count: np.ndarray):
        hashes = heavy[np.lexsort((heavy, count))].view(np.uint64)
        at = np.argsort(hashes)
        self.hashes, self.rank = hashes[at], at.astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        key = (h >> _LIGHT).view(np.int64)
        if not len(self.hashes) or not len(h):
            return key
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, _TOP + self.rank[at], key)


def heavy_hitters(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of n-grams that very many documents hold: at most HEAVY of them.

    Each task condenses its documents into a summary: its most frequent n-grams,
    and of those met once the ones of the smallest hashes, which other tasks
    keep as well. The sums of these summaries decide. All documents are read;
    what reaches the driver is bounded.
    """

    def condense(have: np.ndarray, count: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, back = np.unique(np.concatenate([have, *new]), return_inverse=True)
        c = np.bincount(back, np.concatenate([count, np.ones(len(back) - len(count), np.int64)])).astype(np.int64)
        if len(u) > KEPT:
            most = np.flatnonzero(c > 1)
            if len(most) > KEPT:
                keep = most[np.argpartition(c[most], -KEPT)[-KEPT:]]
            else:
                keep = np.concatenate([most, np.flatnonzero(c == 1)[: KEPT - len(most)]])
            u, c = u[keep], c[keep]
        return u, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, count, new, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for s in Words(part.column(1), LOWER).shingle_sets(k):
                    new.append(s)
                    n += len(s)
                if n > SUMMARY:
                    have, count = condense(have, count, new)
                    new, n = [], 0
        if new:
            have, count = condense(have, count, new)
        yield pa.RecordBatch.from_arrays([pa.array(have.view(np.int64)), pa.array(count)], names=["h", "c"])

    found = texts.mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 3").orderBy(F.desc("c"), "h").limit(HEAVY)
    got = found.toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def _needed(n: np.ndarray | int, m: np.ndarray | int, t: int) -> np.ndarray | int:
    """The least intersection at which sets of n and m link: 100 * i >= t * (n + m - i)."""
    return -(-t * (n + m) // (100 + t))


class Tree:
    """A prefix tree of sorted sets whose edges hold runs of keys.

    Each node knows the least and greatest set below, and the group that all
    sets below are of (None until there is one, then MIXED if they differ).
    """

    MIXED = object()
    __slots__ = ("run", "below", "sets", "least", "most", "kin")

    def __init__(self, run: np.ndarray):
        self.run, self.below, self.sets, self.least, self.most, self.kin = run, {}, [], 1 << 62, 0, None

    def add(self, keys: np.ndarray, who: int, kin: int | None = None) -> None:
        """Insert a set, of a group if one is given, below this root (whose run is empty)."""
        node, at, n = self, 0, len(keys)
        mark = Tree.MIXED if kin is None else kin
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            node.kin = mark if node.kin is None or node.kin == mark else Tree.MIXED
            if at == n:
                node.sets.append(who)
                return
            child = node.below.get(int(keys[at]))
            if child is None:
                leaf = Tree(keys[at:])
                leaf.least, leaf.most, leaf.kin = n, n, mark
                leaf.sets.append(who)
                node.below[int(keys[at])] = leaf
                return
            m = min(len(child.run), n - at)
            same = child.run[:m] == keys[at : at + m]
            common = m if same.all() else int(np.argmin(same))
            if common < len(child.run):  # split the edge
                top = Tree(child.run[:common])
                top.least, top.most, top.kin = child.least, child.most, child.kin
                child.run = child.run[common:]
                top.below[int(child.run[0])] = child
                node.below[int(keys[at])] = top
                child = top
            node, at = child, at + common

    def linked(self, probe: np.ndarray, t: int, kin: int | None = None) -> list[int]:
        """Which sets link with the probe. Overlaps of shared paths are counted once; a subtree is left
        when even all keys that both sides still have can't reach what its least set needs, or when all
        its sets are of the probe's own group ``kin``."""
        out: list[int] = []
        n = len(probe)
        stack = [(self, 0, 0, 0)]  # node, keys of the path, overlap, position in the probe
        while stack:
            node, depth, over, at = stack.pop()
            if kin is not None and node.kin == kin:
                continue
            if len(node.run):
                pos = np.searchsorted(probe[at:], node.run)
                ok = pos < n - at
                over += int(np.count_nonzero(probe[at:][pos[ok]] == node.run[ok]))
                depth += len(node.run)
                at += int(np.searchsorted(probe[at:], node.run[-1], "right"))
            if over + min(n - at, node.most - depth) < _needed(n, max(node.least, -(-t * n // 100)), t):
                continue
            for who in node.sets:
                if over >= _needed(n, depth, t):
                    out.append(who)
            stack.extend((c, depth, over, at) for c in node.below.values())
        return out


def _once(texts: DataFrame) -> DataFrame:
    """One row of each key: repeated rows meet before they are shuffled, in the partitioning of the join that follows."""
    return texts.groupBy("doc_id").agg(F.first("text").alias("text"))


def _verify(texts: DataFrame, pairs: DataFrame, order: Order, k: int, t: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link.

    Texts, which are smaller than their hashes, travel to their pivots: a pivot
    with many partners is dealt in slices of about TREE partners, so no group
    grows with the data. Each slice's partners form a prefix tree that the
    pivot's set traverses.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE).alias("s"))
    dealt = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), "s").alias("slice"), "b")
    routes = dealt.select("a", "slice", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(dealt.select("a", "slice", F.lit(0).alias("role"), F.col("a").alias("id")).distinct())
    some = id_filter(pairs.select("a").unionAll(pairs.select("b")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(some, ids_of(b.column(0)))))

    texts = _once(texts.mapInArrow(tidy(near), "doc_id long, text string"))
    rows = texts.join(routes, texts["doc_id"] == routes["id"]).select("a", "slice", "role", "id", "text")
    rows = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe, tree, members = None, None, None, 0

        def close() -> list[tuple[int, int]]:
            return [(group[0], b) for b in tree.linked(probe, t)] if tree is not None and members and probe is not None else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for part in slices(batch, "text"):
                keys = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                for (a, s, role, who), own in zip(keys, Words(part.column(4), LOWER).shingle_sets(k, order), strict=True):
                    if (a, s) != group:
                        out += close()
                        group, probe, tree, members = (a, s), None, Tree(own[:0]), 0
                    if role == 0:
                        probe = own
                    else:
                        tree.add(own, who)
                        members += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        if group is not None:
            out = close()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


class Forest:
    """Groups that links join, one by one."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart until now."""
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _verify_blocks(texts: DataFrame, members: DataFrame, order: Order, k: int, t: int) -> DataFrame:
    """Links (a, b) between components that join those of each family: rows (fam, rep, comp, m members).

    A family is dealt in blocks of about TREE members by hash. Each two blocks
    meet in a task of their own, where one block's prefix tree is traversed by
    the sets of the other; within a block each set traverses the tree of those
    before it. So a text travels once per block, not once per pair. A traversal
    leaves subtrees of the set's own component, and a link between components
    that are joined already isn't told: what comes out is a forest of the
    components, never a row per pair.
    """
    dealt = members.withColumn("blocks", F.ceil(F.col("m") / TREE).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = dealt.select("fam", "rep", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("fam", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("role"), F.col("rep").alias("id"), "comp")
    some = id_filter(members.select("rep"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(some, ids_of(b.column(0)))))

    texts = _once(texts.mapInArrow(tidy(near), "doc_id long, text string"))
    rows = texts.join(met, texts["doc_id"] == met["id"]).select("fam", "x", "y", "role", "comp", "id", "text")
    rows = rows.repartition("fam", "x", "y").sortWithinPartitions("fam", "x", "y", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, joined = None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for part in slices(batch, "text"):
                keys = zip(*(part.column(i).to_pylist() for i in range(5)), strict=True)
                for (fam, x, y, role, comp), own in zip(keys, Words(part.column(6), LOWER).shingle_sets(k, order), strict=True):
                    if (fam, x, y) != group:
                        group, tree, joined = (fam, x, y), Tree(own[:0]), Forest()
                    if role:
                        out += [(comp, c) for c in tree.linked(own, t, comp) if joined.join(comp, c)]
                    if role != 1:
                        tree.add(own, comp, comp)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _propose(met: DataFrame, t: int) -> DataFrame:
    """Distinct pairs (a, b) that may link, from rows of n-grams that both prefixes hold: a, its size na, place i there; b, nb, j.

    Sizes must fit. All n-grams up to the end of the prefix that ends first are
    counted here, so an intersection is at most this count and what follows
    that prefix; it is also at most the count and what follows the last
    n-gram counted.
    """
    need = lambda have: F.lit(100 + t) * have >= F.lit(t) * (F.col("na") + F.col("nb"))
    rows = met.where(F.lit(100) * F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb"))
    each = rows.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"), F.max("i").alias("i"), F.max("j").alias("j"))
    after_prefix = lambda n: F.ceil(F.lit(t) * F.col(n) / 100) - 1
    last = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1
    return each.where(need(F.col("s") + F.least(last, F.greatest(after_prefix("na"), after_prefix("nb"))))).select("a", "b")


def ngram_classes(documents: DataFrame, n_gram: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: classes of linked n-gram sets.

    Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the set of
    distinct n-grams (as fingerprints of 62 bits), of a shorter text the whole
    sequence as one. Sets link at 100 * intersection >= percent * union;
    component_id is the smallest id reachable. A null or empty text has an
    empty set and links with nothing; equal texts link; rows that repeat an id
    give a row each and are one document: what links with one of them is in the
    component of all. Inside, a text goes by a key of its own, so the order of
    rows plays no part. Rows without an id are documents each, and name no
    component. Texts of any length are taken whole; an empty table gives no
    rows; other columns are ignored.

    The member of a bucket that shares most n-grams with others is compared with
    the rest first, in linear work, which settles groups of copies. Then members
    of a bucket that aren't in one component yet are compared: those of one large
    family (joined by an eighth of the prefix, shared with a bucket's first) in blocks, all others in pairs
    that pass the size and overlap bounds. Nothing is capped or left out.
    """
    t, k = percent, n_gram
    given = documents.select(documents[id_col].cast("long").alias("own_id"), documents[text_col].cast("string").alias("text"))
    texts = given.select(F.lit(0).cast("long").alias("doc_id"), "text")
    order = Order(*heavy_hitters(texts, k))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size, one, two, prefix = [], [], [], []
                for s in Words(part.column(1), LOWER).shingle_sets(k, order):
                    n = len(s)
                    mark = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    size.append(n)
                    one.append(int(mark[0]))
                    two.append(int(mark[1]))
                    prefix.append(s[: n - -(-t * n // 100) + 1])
                off = np.cumsum([0, *map(len, prefix)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(prefix)))],
                    names=["own_id", "hash", "hash2", "n", "s1", "s2", "prefix"],
                )

    # a row's key is a hash of its id and text, checked to stand for one set only
    hashed = F.xxhash64("own_id", "text").alias("hash"), F.xxhash64(F.lit(1), "text", "own_id").alias("hash2")
    signed = stored(given.select("own_id", "text", *hashed).mapInArrow(tidy(sign), "own_id long, hash long, hash2 long, n long, s1 long, s2 long, prefix array<long>"))
    key = distinct_keys(signed.where("n > 0"), ["hash", "hash2"], ["n", "s1", "s2"])
    texts = given.select(*hashed, "text").select(key.alias("doc_id"), "text")
    sets = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(key).alias("rep"), F.min("own_id").alias("low"), F.first("prefix").alias("prefix"))
    entries = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "h")).repartition("h")
    crowd = entries.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(entries.join(crowd, "h"))
    # a group's original shares its n-grams with all its edited copies: what shares most is compared with the others first
    centre = shared.groupBy("rep").agg(F.sum("members").alias("weight"))
    side = shared.join(centre, "rep").repartition("h")
    pivots = side.groupBy("h").agg(F.max(F.struct(F.col("weight"), (-F.col("rep")).alias("r"), F.col("n"), F.col("pos"))).alias("p")).select("h", (-F.col("p.r")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    star = side.join(pivots, "h").where("rep != pivot")
    tried = cut(_propose(star.select(F.col("pivot").alias("a"), F.col("pn").alias("na"), F.col("ppos").alias("i"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j")), t))
    first = components(cut(_verify(texts, tried, order, k, t)))

    # what is left: members of a bucket that aren't in one component yet
    kin = star.groupBy("rep", "pivot", "n").agg(F.count("*").alias("s")).where(F.col("s") * 8 >= F.col("n") - F.ceil(F.lit(t) * F.col("n") / 100) + 1)
    kin = kin.groupBy("rep").agg(F.max_by("pivot", F.struct("s", "pivot")).alias("pivot"))
    family = components(kin.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("component", "fam")
    place = cut(
        centre.select("rep")
        .join(family.withColumnRenamed("id", "rep"), "rep", "left")
        .join(first.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("rep", F.coalesce("fam", "rep").alias("fam"), F.coalesce("component", "rep").alias("comp"))
    )
    size = place.groupBy("fam").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("fam", "m")
    side = shared.select("h", "rep", "n", "pos").join(place.join(size, "fam", "left"), "rep").repartition("h")
    mixed = side.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    x, y = side.join(mixed, "h").alias("x"), side.alias("y")
    apart = x.join(y, F.col("x.h") == F.col("y.h")).where((F.col("x.comp") < F.col("y.comp")) & ((F.col("x.fam") != F.col("y.fam")) | (F.coalesce("x.m", F.lit(0)) <= FAMILY)))
    rest = cut(_propose(apart.select(F.col("x.rep").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("i"), F.col("y.rep").alias("b"), F.col("y.n").alias("nb"), F.col("y.pos").alias("j")), t))
    more = cut(_verify(texts, rest.join(tried.unionAll(tried.select("b", "a")), ["a", "b"], "left_anti"), order, k, t))
    dense = _verify_blocks(texts, place.join(size.where(F.col("m") > FAMILY), "fam").select("fam", "rep", "comp", "m"), order, k, t)
    # the components so far are joined by these links: what was settled isn't gone through again
    of = lambda side: place.select(F.col("rep").alias(side), F.col("comp").alias(f"c{side}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    final = components(cut(between.unionByName(dense)))

    reps = sets.select("n", "s1", "s2", "rep", "low").join(place.select("rep", "comp"), "rep", "left")
    classes = reps.join(final, reps["comp"] == final["id"], "left").select("n", "s1", "s2", "low", F.coalesce("component", "comp", "rep").alias("class"))
    rows = signed.select("own_id", "n", "s1", "s2")
    # an id of several texts is one document: it joins their classes, and an empty text goes with the others
    several = rows.where("own_id is not null").groupBy("own_id").agg(F.min(F.struct("n", "s1", "s2")).alias("lo"), F.max(F.struct("n", "s1", "s2")).alias("hi")).where("lo != hi").select("own_id")
    several = cut(several)
    if several.isEmpty():
        empty_of = None
    else:
        classes = cut(classes)
        meets = rows.where("n > 0").join(several, "own_id", "left_semi").join(classes, ["n", "s1", "s2"]).select("own_id", "class").distinct()
        first_of = meets.groupBy("own_id").agg(F.min("class").alias("a"))
        joined = components(meets.join(first_of, "own_id").select("a", F.col("class").alias("b")))
        classes = classes.join(joined.withColumnRenamed("id", "class"), "class", "left").select("n", "s1", "s2", "low", F.coalesce("component", "class").alias("class"))
        empty_of = first_of.select("own_id", F.col("a").alias("class")).join(joined.withColumnRenamed("id", "class"), "class", "left").select("own_id", F.coalesce("component", "class").alias("class"))
    names = classes.groupBy("class").agg(F.min("low").alias("name"))
    named = classes.join(names, "class").select("n", "s1", "s2", "name")
    out = rows.join(named, ["n", "s1", "s2"], "left")
    if empty_of is not None:
        out = out.join(empty_of.join(names, "class").select("own_id", F.col("name").alias("id_name")), "own_id", "left").withColumn("name", F.coalesce("name", "id_name"))
    return out.select(F.col("own_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("name", "own_id").alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``ngram_classes``."""
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a AND r.c < e.b)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = t.doc_id
"""
