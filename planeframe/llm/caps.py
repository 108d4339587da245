"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

Tight groups collapse first: vectors of one cell of a finer code that lie within
half the linking angle of the cell's first vector form a ball, in which all are
linked without a look. Balls meet in the caps that their members lie in; the
angle of two balls' first vectors, with their radii, decides most pairs of balls
at once, single members against a ball most others, and what is left is compared
vector by vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, distinct_keys, tidy

#: Blocks of the product code, least code words in each block, and how far below a vector's best direction its caps reach.
#: On 4,000 pairs at a cosine of exactly 0.93 (uniform directions, 64 dimensions) every pair met, with 36 caps a vector.
BLOCKS, WORDS, DEPTH, SEED = 2, 384, 0.07, 11
#: Directions for each vector of the largest label: there are more code words the more vectors there are, so that a cap holds
#: as many unrelated ones at any size. With more words a vector's best directions lie closer, so caps reach down by this power less.
DIRECTIONS, CLOSER = 100, 0.07
#: Blocks and words of the finer code whose cells propose balls, and vectors of a cell beyond which it gives several.
CELL_BLOCKS, CELL_WORDS, CELL_SIZE = 4, 64, 4096
#: Rows of one block when a cap's balls, or the vectors of two balls, are compared.
BLOCK = 1024
#: Margin of decisions by angles; vectors compared one by one are decided by their cosine alone.
MARGIN = 1e-7


class ProductCode:
    """Filter directions (c1, .., cm) / sqrt(m), each ci one of ``words`` random unit vectors of a block.

    A vector is rotated by signs and a fast Hadamard transform first; then the
    inner products with all words^m directions are sums of m table entries, and
    branch and bound over blocks lists just those above a vector's height.
    The height is the vector's best inner product less ``depth``: near vectors
    have near heights, and every vector is in one cap at least.
    """

    def __init__(self, dim: int, blocks: int = BLOCKS, words: int = WORDS, depth: float = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = max(blocks, 1 << (dim - 1).bit_length())
        # few dimensions need few directions: on a line there are two
        words = 2 if self.size == blocks else words if self.size >= 16 * blocks else min(words, 12 * self.size // blocks)
        self.blocks, self.words, self.depth = blocks, words, depth
        self.signs = [rng.choice([-1.0, 1.0], self.size) for _ in range(3)]
        code = rng.standard_normal((blocks, words, self.size // blocks))
        if self.size == blocks:
            code[:] = np.array([1.0, -1.0])[:, None]
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for s in self.signs:
            y *= s
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), self.size)
                h *= 2
            y /= np.sqrt(self.size)
        return y

    def cell(self, unit: np.ndarray) -> np.ndarray:
        """A number for the best word of each block."""
        best = np.einsum("nbd,bwd->nbw", self.rotate(unit).reshape(len(unit), self.blocks, -1), self.code).argmax(axis=2)
        return (best * np.array([self.words**j for j in range(self.blocks)])).sum(axis=1)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter id) of every cap that each unit vector lies in."""
        part = np.einsum("nbd,bwd->nbw", self.rotate(unit).reshape(len(unit), self.blocks, -1), self.code) / np.sqrt(self.blocks)
        best = part.max(axis=2)
        rest = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))], axis=1)
        need = best.sum(axis=1) - self.depth
        row, fid, score = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b in range(self.blocks):
            s = score[:, None] + part[row, b]
            keep = s + rest[row, b][:, None] >= need[row][:, None]
            at, word = np.nonzero(keep)
            row, fid, score = row[at], fid[at] * self.words + word, s[at, word]
        return row, fid


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of vectors of equal length, at most 1000 at a time."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        for k in range(0, len(rows), 1000):
            yield n, rows[k : k + 1000]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows that agree in the first columns, of an input sorted by them."""
    group, held = None, []
    for b in batches:
        own = list(zip(*(b.column(c).to_pylist() for c in range(keys)), strict=True))
        at = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k] != own[at]:
                if own[at] != group:
                    if held:
                        yield group, pa.Table.from_batches(held).combine_chunks()
                    group, held = own[at], []
                held.append(b.slice(at, k - at))
                at = k
    if held:
        yield group, pa.Table.from_batches(held).combine_chunks()


def _blocked(rows: DataFrame, blocks: str, others: str, row_first: bool) -> DataFrame:
    """Deal each row to its own block (by hash of its rep, of ``blocks`` many) and copy it to the ``others`` blocks that it meets: columns i, j."""
    own = F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    out = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
    return out.withColumn("i", F.col("_own" if row_first else "_other")).withColumn("j", F.col("_other" if row_first else "_own"))


def near_vectors(table: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", depth: float = DEPTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of one label with cosine >= ``cosine``.

    Equal vectors of a label collapse first; the links of copies count. Then
    balls collapse, and meet in the caps that a member of both lies in. A ball
    is counted, not gone through, where the triangle inequality says that all or
    none of it links; all else is decided by the cosine in double precision.
    Vectors of unequal length don't link. Null, empty or zero vectors, those
    with null or non-finite components, and those without a label get n_links 0
    and a component of their own; rows that repeat a vec_id, with one vector or
    several, under one label or several, give a row each and are judged each by
    their vector and label: inside, a vector of a label goes by a key of its own.
    Rows without a vec_id count as others and name no component. An empty table
    gives no rows; other columns are ignored.

    A cell, a cap or a pair of balls with very many rows is dealt in blocks by
    hash, and every two blocks meet in a task of their own: no group is
    collected, nothing is capped. A pair that shares no cap is missed.
    """
    raw = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].alias("v"), table[label_col].cast("string").alias("label"))
    fine = "v is not null and size(v) > 0 and label is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    distinct = cut(raw.where(fine).groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")))
    distinct = distinct.withColumn("rep", distinct_keys(distinct, ["label", "v"]))
    phi = float(np.arccos(cosine))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for n, rows in _by_size(b.column(0)):
                code = codes.setdefault(n, ProductCode(n, CELL_BLOCKS, CELL_WORDS, seed=SEED + 1))
                out[rows] = code.cell(_unit(_matrix(b.column(0).take(pa.array(rows))))) * 65536 + n % 65536
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "cell"])

    distinct = distinct.select("v", "label", "rep", "copies", "low")
    vector = distinct.schema["v"].dataType.simpleString()
    celled = cut(distinct.mapInArrow(tidy(cells), f"v {vector}, label string, rep long, copies long, low long, cell long"))
    crowded = celled.groupBy("label", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_SIZE)
    spread = celled.join(crowded, ["label", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("n", F.lit(1)) / CELL_SIZE)))
    in_cells = spread.select("label", "cell", "part", "rep", "copies", "v").repartition("label", "cell", "part").sortWithinPartitions("label", "cell", "part", "rep")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader, of = None, None, 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            rep = b.column(3).to_numpy()
            ball, angle = rep.copy(), np.zeros(len(rep))
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if keys[at] != group:
                    group, leader, of = keys[at], _unit(_matrix(b.column(5).slice(at, 1))), rep[at]
                if k - at > 1 or of != rep[at]:
                    off = _angle(_unit(_matrix(b.column(5).slice(at, k - at))) @ leader[0])
                    near = np.flatnonzero(off <= phi / 2 - MARGIN)
                    ball[at + near], angle[at + near] = of, off[near]
                    if rep[at] == of:
                        angle[at] = 0.0
                at = k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), b.column(5), pa.array(ball), pa.array(angle)], names=["label", "rep", "copies", "v", "ball", "angle"])

    members = cut(in_cells.mapInArrow(tidy(collapse), f"label string, rep long, copies long, v {vector}, ball long, angle double"))
    size = members.groupBy("ball").agg(F.sum("copies").alias("n"), F.count("*").alias("m"), F.max("angle").alias("radius"))
    balls = cut(members.where("rep = ball").select("label", "ball", "v").join(size, "ball"))
    largest = balls.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words = max(WORDS, int(np.ceil(np.sqrt(DIRECTIONS * largest))))
    reach = depth * (WORDS / words) ** CLOSER

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for b in batches:
            for n, rows in _by_size(b.column(0)):
                some = b.take(pa.array(rows))
                row, fid = codes.setdefault(n, ProductCode(n, words=words, depth=reach)).decode(_unit(_matrix(some.column(0))))
                ball = some.column(2).to_numpy()[row]
                fid = fid * 65536 + n % 65536
                order = np.lexsort((fid, ball))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(ball[order]) != 0) | (np.diff(fid[order]) != 0)
                first = order[new]
                yield pa.RecordBatch.from_arrays([some.column(1).take(pa.array(row[first])), pa.array(fid[first]), pa.array(ball[first])], names=["label", "cap", "ball"])

    listed = members.select("v", "label", "ball").mapInArrow(tidy(caps), "label string, cap long, ball long").distinct()
    listed = cut(listed)
    crowd = listed.groupBy("label", "cap").agg(F.count("*").alias("in_cap")).where("in_cap > 1").withColumn("blocks", F.ceil(F.col("in_cap") / BLOCK).cast("int"))
    met = listed.join(crowd, ["label", "cap"]).join(balls.select("ball", "v", "radius"), "ball")
    met = met.withColumn("own", F.pmod(F.xxhash64("ball"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "cap", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "ball", "own", "v", "radius")
    met = met.repartition("label", "cap", "i", "j").sortWithinPartitions("label", "cap", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), t in _groups(batches, 4):
            if t.num_rows < 2:
                continue
            part = t.to_batches()[0]
            ball, own, radius = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(7).to_numpy()
            unit = _unit(_matrix(part.column(6)))
            x, y = (np.arange(len(ball)), np.arange(len(ball))) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
            cos, both = unit[x] @ unit[y].T, radius[x][:, None] + radius[y][None, :]
            single = both == 0
            # an angle that the radii can't bring to the limit is none; first by cosines, which are cheap
            a, b = np.nonzero(np.where(single, cos >= cosine, cos >= np.cos(np.minimum(np.pi, phi + both + MARGIN))))
            keep = ball[x[a]] < ball[y[b]] if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            if len(a):
                sure = single[a, b] | (_angle(cos[a, b]) + both[a, b] <= phi - MARGIN)
                p, q = ball[x[a]], ball[y[b]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sure)], names=["a", "b", "sure"])

    pairs = cut(met.mapInArrow(tidy(compare), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    about = balls.select("ball", "n", "m", "radius", "v")
    way = pairs.select("a", "b", "sure").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sure"))
    whole = way.where("sure").join(about.select(F.col("ball").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("whole"))

    # pairs of balls that aren't decided as wholes: each member against the other ball
    open_ = way.where("NOT sure").join(about.select(F.col("ball").alias("b"), F.col("n").alias("bn"), F.col("m").alias("bm"), F.col("radius").alias("br"), F.col("v").alias("bv")), "b")
    one = members.select(F.col("ball").alias("a"), "rep", "v").join(open_, "a").select("a", "rep", "v", "b", "bn", "bm", "br", "bv")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, rows in _by_size(b.column(2)):
                some = b.take(pa.array(rows))
                cos = np.einsum("nd,nd->n", _unit(_matrix(some.column(2))), _unit(_matrix(some.column(7))))
                radius = some.column(6).to_numpy()
                off = _angle(cos)
                every = np.where(radius == 0, cos >= cosine, off + radius <= phi - MARGIN)
                rim = (radius > 0) & ~every & (off - radius <= phi + MARGIN)
                at = np.flatnonzero(every | rim)
                got = some.take(pa.array(at))
                links = np.where(every, some.column(4).to_numpy(), 0)[at]
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(3), got.column(1), got.column(2), got.column(5), pa.array(links), pa.array(rim[at])], names=["a", "b", "rep", "v", "bm", "links", "rim"])

    told = cut(one.mapInArrow(tidy(against), f"a long, b long, rep long, v {vector}, bm long, links long, rim boolean"))
    rims = told.where("rim")
    loads = rims.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("left"), F.ceil(F.max("bm") / BLOCK).cast("int").alias("right"))
    sides = _blocked(rims.join(loads, "b"), "left", "right", True).select("b", "i", "j", F.lit(0).alias("side"), "rep", "a", F.lit(0).cast("long").alias("copies"), "v")
    sides = sides.unionByName(
        _blocked(members.withColumnRenamed("ball", "b").join(loads, "b"), "right", "left", False).select("b", "i", "j", F.lit(1).alias("side"), "rep", F.col("b").alias("a"), "copies", "v")
    ).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "side")

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, _, _), t in _groups(batches, 3):
            part = t.to_batches()[0]
            side = part.column(3).to_numpy()
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            unit = _unit(_matrix(part.column(7)))
            links = (unit[x] @ unit[y].T >= cosine) @ part.column(6).to_numpy()[y]
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([part.column(5).take(pa.array(x[at])), pa.array(np.full(len(at), b)), part.column(4).take(pa.array(x[at])), pa.array(links[at])], names=["a", "b", "rep", "links"])

    single = cut(sides.mapInArrow(tidy(singly), "a long, b long, rep long, links long").unionByName(told.where("links > 0").select("a", "b", "rep", "links")))
    weight = single.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = pairs.where("sure").select("a", "b").unionByName(single.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = components(edges)
    placed = balls.select("ball", "n").join(whole, F.col("ball") == F.col("a"), "left").join(joined, F.col("ball") == F.col("id"), "left").select("ball", (F.col("n") - 1 + F.coalesce("whole", F.lit(0))).alias("common"), F.coalesce("component", "ball").alias("component_id"))
    # a component's name is the smallest id of its vectors
    named = members.select("rep", "ball").join(celled.select("rep", "low"), "rep").groupBy("ball").agg(F.min("low").alias("low")).join(placed.select("ball", "component_id"), "ball")
    placed = placed.join(named.groupBy("component_id").agg(F.min("low").alias("name")), "component_id").select("ball", "common", F.col("name").alias("component_id"))
    classes = members.select("label", "v", "rep", "ball").join(placed, "ball").join(weight, "rep", "left").select("label", "v", (F.col("common") + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return raw.join(classes, ["label", "v"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole table of embeddings; cases as in ``near_vectors``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a AND r.c < l.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
"""
