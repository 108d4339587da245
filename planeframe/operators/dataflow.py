"""Project, Filter, Join, Fuse, Compose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..functions.predicates import family, predicate
from .relation import EVIDENCE_NAMES, IDS, ORDER, Relation, col, ranked


def _need(r: Relation, names) -> None:
    if missing := [n for n in names if n not in r.fields]:
        raise ExecutionError(f"no fields {missing}; there are {list(r.fields)}")


def project(r: Relation, names) -> Relation:
    """Keep and order fields; repeated rows stay."""
    _need(r, names)
    return r.of(r.rows.select(*map(col, names), ORDER, IDS), names)


def filter_rows(r: Relation, name: str, op: str, value) -> Relation:
    """Rows for which one predicate holds; see ``predicate`` for nulls and types."""
    _need(r, [name])
    kind = r.rows.schema[name].dataType
    return r.of(r.rows.where(predicate(col(name), kind, op, value, name)), r.fields)


def join_rows(left: Relation, right: Relation, left_on, right_on, left_alias: str = "left", right_alias: str = "right", ordered: bool = True) -> Relation:
    """Inner equi-join; null keys match nothing, keys of different type families never match.

    All fields of both sides remain under their alias. Output order is that of
    the left side, then of the right: a pair of both orders, so no row has to
    wait for a number. With ``ordered=False`` there is none.
    """
    _need(left, left_on)
    _need(right, right_on)
    a = left.rows.select(*[col(f).alias(f"{left_alias}.{f}") for f in left.fields], F.col(ORDER).alias("_a"), F.col(IDS).alias("_ia"))
    b = right.rows.select(*[col(f).alias(f"{right_alias}.{f}") for f in right.fields], F.col(ORDER).alias("_b"), F.col(IDS).alias("_ib"))
    conditions = []
    for x, y in zip(left_on, right_on, strict=True):
        fx, fy = (family(d.schema[f"{s}.{n}"].dataType) for d, s, n in ((a, left_alias, x), (b, right_alias, y)))
        if {fx, fy} & {"array", "struct", "map"}:
            raise ExecutionError(f"{x} and {y} must be scalars to be joined")
        cx, cy = col(f"{left_alias}.{x}"), col(f"{right_alias}.{y}")
        if fx == fy == "number":
            cx, cy = (c.cast("int") if d.schema[n].dataType.typeName() == "boolean" else c for c, d, n in ((cx, a, f"{left_alias}.{x}"), (cy, b, f"{right_alias}.{y}")))
        conditions.append(cx == cy if fx == fy else F.lit(False))
    fields = [f"{left_alias}.{f}" for f in left.fields] + [f"{right_alias}.{f}" for f in right.fields]
    rows = a.join(b, reduce(lambda p, q: p & q, conditions), "inner")
    order = F.struct("_a", "_b") if ordered else F.lit(0).cast("long")
    rows = rows.select(*map(col, fields), order.alias(ORDER), F.array_distinct(F.concat("_ia", "_ib")).alias(IDS))
    both = [r.evidence for r in (left, right) if r.evidence is not None]
    evidence = compose_evidence(both) if both else None
    return Relation(tuple(fields), rows, evidence).of(rows, fields) if evidence is not None else Relation(tuple(fields), rows)


#: Values in a tile at most; rows of an input partition, as a power of two, that are put into tiles together; values of the right that come in turn beside one of the left.
TILE, STRETCH, RUN = 4096, 16, 256


def _cut(values: Column, most: int) -> Column:
    """An array that isn't empty, in slices."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / most).cast("int")), lambda i: F.slice(values, i * most + 1, F.lit(most)))


def tiles(df: DataFrame, key: str, value: str) -> Relation:
    """The values of each key in arrays of ``TILE`` at most, made of neighbours in the input: a relation of key and ``tile``, without an order."""
    lists = df.groupBy(key, F.shiftright(F.monotonically_increasing_id(), STRETCH).alias("_stretch")).agg(F.collect_list(F.struct(F.col(value).alias("v"))).alias("_all"))
    rows = lists.select(key, F.explode(_cut(F.transform("_all", lambda x: x["v"]), TILE)).alias("tile"))
    return Relation((key, "tile"), rows.select(key, "tile", F.lit(0).cast("long").alias(ORDER), F.array().cast("array<string>").alias(IDS)))


def join_pairs(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """All pairs (a, b) of values that have a key in common, for tables with many rows of few keys on both sides; null keys match nothing.

    What is joined and dealt out are tiles: a row stands for up to ``TILE`` x
    ``TILE`` pairs, so the tasks that write them out are as many as there are
    shuffle partitions, however few keys there are. Tiles that are neighbours
    on the left meet in one task, and pairs come in an order that takes little
    room in columns: a value of the left ``RUN`` times, beside it the same
    ``RUN`` values of the right as for the value before.
    """
    met = join_rows(tiles(left, key, a), tiles(right, key, b), [key], [key], ordered=False).rows
    met = met.select(col(f"left.{key}").alias("_key"), col("left.tile").alias("_a"), col("right.tile").alias("_b"))
    dealt = met.repartitionByRange(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("_key"), F.get("_a", F.lit(0)))
    # in two steps: an explode's compiled code keeps all rows that it makes of one, also those of explodes that follow it
    beside = F.flatten(F.transform(_cut(F.col("_b"), RUN), lambda run: F.transform("_a", lambda x: F.struct(x.alias(a), run.alias("_run")))))
    return dealt.select(F.inline(beside)).select(a, F.explode("_run").alias(b))


#: What makes two pieces of evidence one and the same observation.
PROVENANCE = ("source_id", "locator", "version", "valid_from", "valid_to")


#: Rows up to which a ranking whose size is known is numbered in one task.
BOUNDED = 100_000


def _places(evidence: DataFrame) -> Column:
    """The order of evidence as an array of numbers, compared element by element."""
    kind = evidence.schema[ORDER].dataType.typeName()
    return F.col(ORDER) if kind == "array" else F.array(F.col(ORDER).cast("long"))


def _rank(evidence: DataFrame, bound: int | None) -> DataFrame:
    """Number the rows from 1: by one window if a limit bounds them, else in parts of 65,536 places, which computes the rows twice."""
    if bound is not None and bound <= BOUNDED:
        return evidence.withColumn("_rank", F.row_number().over(Window.orderBy(ORDER)).cast("long")).drop(ORDER)
    at = _places(evidence)
    part = F.concat(F.slice(at, 1, F.size(at) - 1), F.array(F.shiftright(F.element_at(at, -1), 16)))
    return ranked(evidence, part, F.col(ORDER)).drop(ORDER)


def fuse(inputs: list[DataFrame], limit: int = 20, rank_constant: int = 60, bounds: list[int | None] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked evidence frames: (evidence columns, score rounded to 12, new order).

    Each input gives 1 / (rank_constant + rank) to what it ranks, ranks from 1;
    what stands twice counts twice. Contributions are added in input and rank
    order, so the double sum doesn't depend on partitioning. Order: score
    descending, then first seen. ``bounds`` says how many rows an input has at
    most, where that is known; all others are ranked in parts of their order.
    """
    bounds = bounds or [None] * len(inputs)
    tagged = [_rank(e, n).withColumn("_in", F.lit(i)) for i, (e, n) in enumerate(zip(inputs, bounds, strict=True))]
    all_ = reduce(DataFrame.unionByName, tagged).withColumn("_gain", 1.0 / (F.lit(rank_constant) + F.col("_rank")))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k_{c}") for c in PROVENANCE]
    place = F.struct("_in", "_rank")
    gains = F.array_sort(F.collect_list(F.struct("_in", "_rank", "_gain")))
    fused = all_.groupBy(*key).agg(
        F.aggregate(gains, F.lit(0.0), lambda s, g: s + g["_gain"]).alias("_score"),
        F.min(place).alias("_first"),
        F.min_by(F.struct(*[c for c in EVIDENCE_NAMES if c != ORDER]), place).alias("e"),
    )
    top = fused.orderBy(F.desc("_score"), "_first").limit(limit)
    top = top.withColumn("_new", F.row_number().over(Window.orderBy(F.desc("_score"), "_first")).cast("long") - 1)
    return top.select(*[F.col(f"e.{c}") for c in EVIDENCE_NAMES if c not in ("score", ORDER)], F.round("_score", 12).alias("score"), F.col("_new").alias(ORDER)).select(*EVIDENCE_NAMES)


def compose_evidence(inputs: list[DataFrame]) -> DataFrame:
    """The union of evidence in input order; of an id that stands several times the first stays.

    A row's place is the number of its input, then its place there: an array, so
    that places of any size, and of unions of unions, keep their order.
    """
    all_ = reduce(DataFrame.unionByName, [e.withColumn(ORDER, F.concat(F.array(F.lit(i).cast("long")), _places(e))) for i, e in enumerate(inputs)])
    w = Window.partitionBy("evidence_id").orderBy(ORDER)
    return all_.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*EVIDENCE_NAMES)
