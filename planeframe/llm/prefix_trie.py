"""Operator 11: the trie of conversations by their common first turns.

1. Turns are numbered in order by a sort over ranges, so a conversation of any
   length is spread over tasks; each task numbers its part and a table of parts
   carries the counts on. From here on a turn is its 64-bit key and its size;
   ``_exact_keys`` has compared the contents behind each key.
2. Rebuilt conversations are scanned in blocks of turns: numpy sums of key *
   base ** place modulo two primes are the fingerprints of all prefixes; sums of
   whole blocks are carried on in the same way.
3. Prefixes of one length and fingerprint form a group. Its representative is
   the smallest member: turn by turn, each member must have its turn under the
   same parent. Members that differ are split off and compared again.
4. Rollup without walking the levels: the smallest member of a node is that of
   all nodes below it on its own path, so a conversation has one suffix sum of
   what its own nodes save and one mark if it ends a leaf; a node adds those of
   its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tidy

#: Turns of a conversation that one task scans at most.
BLOCK = 4096
#: Every conversation shares turns with the one whose id is the last multiple of GROUP; at most LENT of them.
GROUP, LENT = 5, 8
#: Bytes of ids that are handed on at once to be digested.
CHUNK = 1 << 16
_PRIMES = (2147483647, 2147483629)
_BASES = (1402946773, 987654337)


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(BLOCK, np.uint64)
    for k in range(1, BLOCK):
        out[k] = int(out[k - 1]) * base % prime
    return out


def _exact_keys(turns: DataFrame) -> DataFrame:
    """Turns whose ``key`` stands for one content only: a group's smallest and largest content are compared, contents that share a key get others."""
    content, again = F.struct("role", "text"), 0
    while True:
        seen = turns.groupBy("key").agg(F.min(content).alias("low"), F.max(content).alias("high"))
        bad = seen.where("low != high").select("key", "low")
        if bad.isEmpty():
            return turns
        again += 1
        other = F.col("low").isNotNull() & (content != F.col("low"))
        turns = stored(turns.join(bad, "key", "left").withColumn("key", F.when(other, F.xxhash64("key", "role", "text", F.lit(again))).otherwise(F.col("key"))).drop("low"))


def _numbered(turns: DataFrame) -> DataFrame:
    """(c, part, at, key, size): the place of each turn among the turns of its conversation in one part of the sorted table."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            c = b.column("c").to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            at = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]]))) + 1
            if c[0] == last:
                at[: first[1] if len(first) > 1 else len(c)] += done
            last, done = c[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(np.full(len(c), part, np.int32)), pa.array(at, pa.int64()), b.column("key"), b.column("size")], names=["c", "part", "at", "key", "size"])

    # equal rows have no order among them: the salt lets the ranges cut between them
    ranged = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("c", "key", "size").mapInArrow(tidy(run), "c long, part int, at long, key long, size long")


def _scanned(rows: DataFrame) -> DataFrame:
    """Adds f0, f1, the sums over a turn's block up to it, and e0, e1, those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [_powers(b, p) for b, p in zip(_BASES, _PRIMES, strict=True)]
        last, carry = None, [0, 0]
        for b in batches:
            c, d, block, key = (b.column(x).to_numpy(zero_copy_only=False) for x in ("c", "d", "block", "key"))
            if not len(c):
                continue
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])]))
            size = np.diff(np.concatenate([first, [len(c)]]))
            blocks, of = np.unique(block, return_inverse=True)
            sums = []
            for j, (base, prime) in enumerate(zip(_BASES, _PRIMES, strict=True)):
                p = np.uint64(prime)
                far = np.array([pow(base, int(x) * BLOCK + 1, prime) for x in blocks], np.uint64)[of]
                term = (key.view(np.uint64) % p + np.uint64(1)) * table[j][(d - 1) % BLOCK] % p * far % p
                total = np.concatenate([[np.uint64(0)], np.cumsum(term)])
                before = np.zeros(len(first), np.uint64)
                if (int(c[0]), int(block[0])) == last:
                    before[0] = carry[j]
                inner = total[1:] - np.repeat(total[first] - before, size)
                carry[j] = int(inner[-1] % p)
                sums += [pa.array((inner % p).astype(np.int64)), pa.array(((inner - term) % p).astype(np.int64))]
            last = (int(c[-1]), int(block[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("c", "d", "block", "key", "size", "length")), *sums], names=["c", "d", "block", "key", "size", "length", "f0", "e0", "f1", "e1"])

    return rows.repartition("c", "block").sortWithinPartitions("c", "d").mapInArrow(tidy(run), "c long, d long, block long, key long, size long, length long, f0 long, e0 long, f1 long, e1 long")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of rebuilt conversations: c, d, block, key, size, length; conversations: c, length)."""
    numbered = stored(_numbered(turns))
    parts = numbered.groupBy("c", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("c"))})
    convs = parts.groupBy("c").agg(F.max("n").alias("n")).withColumns({"base": F.expr(f"c - c % {GROUP}"), "h": F.expr(f"crc32(cast(cast(c as string) as binary)) % {LENT + 1}")})
    convs = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.expr("m + greatest(n - h, 0)"))
    convs = stored(convs.select("c", "base", "h", "m", "length"))
    placed = numbered.join(parts.select("c", "part", "before").join(convs, "c"), ["c", "part"]).withColumn("place", F.expr("before + at"))
    own = placed.where("place > h").select("c", F.expr("m + place - h").alias("d"), "key", "size", "length")
    lent = placed.where(f"c % {GROUP} = 0 and place <= {LENT}").select(F.col("c").alias("base"), F.col("place").alias("d"), "key", "size")
    lent = lent.join(convs, "base").where("d <= m").select("c", "d", "key", "size", "length")
    return own.unionByName(lent).withColumn("block", F.expr(f"(d - 1) div {BLOCK}")), convs.select("c", "length")


def _prefixes(rows: DataFrame, convs: DataFrame, mask: int) -> DataFrame:
    """(c, d, node, parent, key, size, last): each prefix of each conversation with its own fingerprint and that of the prefix before it."""
    scanned = stored(_scanned(rows))
    far = scanned.where(f"d % {BLOCK} = 0").select("c", (F.col("block") + 1).alias("block"), "f0", "f1")
    up = Window.partitionBy("c").orderBy("block")
    far = far.select("c", "block", F.sum("f0").over(up).alias("g0"), F.sum("f1").over(up).alias("g1"))
    zero = F.lit(0).cast("long")
    near = scanned.where("block = 0").withColumns({"g0": zero, "g1": zero})
    summed = near.unionByName(scanned.where("block > 0").join(far, ["c", "block"]))
    label = lambda x: F.expr(f"shiftleft(({x}0 + g0) % {_PRIMES[0]}, 31) + ({x}1 + g1) % {_PRIMES[1]}").bitwiseAND(F.lit(mask))
    out = summed.select("c", "d", label("f").alias("node"), label("e").alias("parent"), "key", "size", (F.col("d") == F.col("length")).alias("last"))
    root = convs.select("c", zero.alias("d"), zero.alias("node"), zero.alias("parent"), zero.alias("key"), zero.alias("size"), (F.col("length") == 0).alias("last"))
    return stored(out.unionByName(root))


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): groups in which every member has the representative's turn under the representative's parent, at each depth.

    By induction over the depth their whole prefixes are equal. What decides is
    the same for equal prefixes, so these are never parted.
    """
    again = 0
    while True:
        own = F.struct("c", "key", "parent")
        agg = rows.groupBy("d", "node").agg(
            F.count("*").alias("n_convs"), F.min(own).alias("head"), F.max("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("parent").alias("left"), F.max("parent").alias("right")
        )
        nodes = stored(agg)
        bad = nodes.where("low != high or left != right").select("d", "node", F.col("head.key").alias("head_key"), F.col("head.parent").alias("head_parent"))
        if bad.isEmpty():
            return rows, nodes.select("d", "node", "n_convs", F.col("head.c").alias("c"), F.col("head.parent").alias("parent"), "size")
        again += 1
        differs = F.col("head_key").isNotNull() & ((F.col("key") != F.col("head_key")) | (F.col("parent") != F.col("head_parent")))
        moved = rows.join(bad, ["d", "node"], "left").withColumn("node", F.when(differs, F.xxhash64("node", "key", "parent", F.lit(again))).otherwise(F.col("node")))
        moved = stored(moved.drop("head_key", "head_parent", "parent"))
        above = moved.select("c", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
        rows = stored(moved.join(above, ["c", "d"], "left").withColumn("parent", F.coalesce("parent", F.lit(0).cast("long"))))


def _digests(ends: DataFrame) -> DataFrame:
    """(d, node, ends): SHA-256 of a node's ids in order. Ids travel in runs of CHUNK bytes and are digested as a stream: a digest has one order, but no group is ever held."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        out: list[tuple[int, int, int, str]] = []
        for b in batches:
            for d, node, c in zip(*(b.column(x).to_pylist() for x in ("d", "node", "c")), strict=True):
                if (d, node) != key or size > CHUNK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (d, node), c, [], 0
                ids.append(str(c))
                size += len(ids[-1])
                if len(out) >= 1000:
                    yield batch(out)
        if ids:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield batch(out)

    def batch(out: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=["d", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for d, node, ids in zip(*(b.column(x).to_pylist() for x in ("d", "node", "ids")), strict=True):
                if (d, node) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, node), hashlib.sha256(ids.encode())
            if out:
                yield told(out)
        if key is not None:
            yield told([(*key, sha.hexdigest())])

    def told(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["d", "node", "ends"])

    runs_ = ends.repartitionByRange("d", "node", "c").sortWithinPartitions("d", "node", "c").mapInArrow(tidy(runs), "d long, node long, first long, ids string")
    return runs_.repartition("d", "node").sortWithinPartitions("d", "node", "first").mapInArrow(tidy(digest), "d long, node long, ends string")


def prefix_trie(conversations: DataFrame, key_mask: int = -1, node_mask: int = -1) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix.

    Turns without an id belong to no conversation and give nothing; a null role or
    text is an empty one; turns of equal number follow each other by role, then
    text; repeated rows are turns each; conversations and texts of any length are
    taken whole; an empty table has no root. The id of a conversation's group
    rounds to zero, so that of -3 is 0. Other columns play no part. The masks
    weaken keys and fingerprints, which tests use to force collisions.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = _exact_keys(turns.withColumns({"key": F.xxhash64("role", "text").bitwiseAND(F.lit(key_mask)), "size": F.octet_length("text").cast("long")}))
    rows, convs = _rebuilt(turns)
    rows, nodes = _verified(_prefixes(rows, convs, node_mask))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, ["d", "node"], "left").fillna(0, ["n_children"]))
    # what the nodes below, and on, a node save on the path of its smallest member, in blocks of the path
    shared = nodes.where("n_convs > 1").select("c", "d", "node", F.expr(f"d div {BLOCK}").alias("block"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    blocks = shared.groupBy("c", "block").agg(F.sum("own").alias("sum"))
    later = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"later": F.coalesce(F.sum("sum").over(later), F.lit(0)), "all": F.sum("sum").over(Window.partitionBy("c"))})
    within = F.sum("own").over(Window.partitionBy("c", "block").orderBy(F.desc("d")))
    path = shared.withColumn("within", within).join(blocks, ["c", "block"]).select("d", "node", F.expr("within + later").alias("path"), F.col("all").alias("own_all"))
    # what each conversation adds to all nodes that it is a member of
    leaves = nodes.where("n_children = 0").select("c", F.lit(1).alias("leaf"))
    adds = convs.join(blocks.select("c", "all").distinct(), "c", "left").join(leaves, "c", "left").fillna(0, ["all", "leaf"])
    adds = adds.withColumn("block", F.explode(F.expr(f"sequence(0, length div {BLOCK})")))
    rolled = rows.withColumn("block", F.expr(f"d div {BLOCK}")).join(adds, ["c", "block"]).groupBy("d", "node").agg(F.sum("leaf").alias("n_leaves"), F.sum("all").alias("members"))
    heads = nodes.select((F.col("d") + 1).alias("d"), F.col("node").alias("parent"), F.col("c").alias("parent_conv_id"))
    out = nodes.join(rolled, ["d", "node"]).join(path, ["d", "node"], "left").join(_digests(rows.where("last").select("d", "node", "c")), ["d", "node"], "left").join(heads, ["d", "parent"], "left")
    saved = F.coalesce(F.expr("members - own_all + path"), F.lit(0)).cast("long")
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        saved.alias("saved_tokens"), ends.alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(s) + 1), lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) % 9 AS h
  FROM ids),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
lent AS (SELECT c.conv_id, o.place AS d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h),
many AS (SELECT conv_id, count(*) AS m FROM lent GROUP BY conv_id),
turns AS (
  SELECT * FROM lent UNION ALL
  SELECT o.conv_id, coalesce(m, 0) + place - h, role, text FROM own o JOIN convs USING (conv_id) LEFT JOIN many USING (conv_id) WHERE place > h),
whole AS (SELECT conv_id, coalesce(t, []) AS t FROM convs LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY d) AS t FROM turns GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, t[1:d] AS p, d, len(t) = d AS last FROM (SELECT *, unnest(generate_series(0, len(t))) AS d FROM whole)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
  FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.p[n.d].text) END AS saved FROM nodes n LEFT JOIN kids USING (d, p)),
up AS (
  SELECT u AS d, p[1:u] AS p, sum(saved) AS saved, count(*) FILTER (WHERE k = 0) AS leaves
  FROM (SELECT *, unnest(generate_series(0, d)) AS u FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.k::BIGINT AS n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN up USING (d, p) LEFT JOIN nodes a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1]
"""
