"""A property graph over vertex and edge frames: bounded simple paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KernelValidationError
from ..model import EffectLevel, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, now
from ..operators import Relation, evidence_frame, with_order
from ..operators.relation import IDS, ORDER, evidence_id
from .base import Source, SourceResult

FIELDS = ("start_id", "end_id", "hops", "node_path", "relation_path", "edge_path", "score")


def steps(edges: DataFrame, direction: str = "out", relations=()) -> DataFrame:
    """(node, relation, edge_id, next, weight): the steps that a direction and a relation filter allow."""
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    out = e.select(F.col("source_id").alias("node"), "relation", "edge_id", F.col("target_id").alias("next"), F.col("weight").cast("double").alias("weight"))
    back = e.select(F.col("target_id").alias("node"), "relation", "edge_id", F.col("source_id").alias("next"), F.col("weight").cast("double").alias("weight"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back.where("node <> next"))
    raise KernelValidationError(f"no direction {direction}")


def paths(starts: DataFrame, edges: DataFrame, direction: str = "out", relations=(), min_hops: int = 1, max_hops: int = 2, limit: int | None = 100) -> DataFrame:
    """Simple paths of min_hops..max_hops edges from the starts (start_id): FIELDS and ``_bfs``.

    One join per hop on the frontier's end, with nothing broadcast by hand. With
    a limit, the result holds limit + 1 paths at most, namely the first in the
    order in which a breadth-first search (starts sorted; steps by relation,
    edge, next node) finds them: that order is lexicographic on (hops, start,
    steps), so it may cut each hop's frontier once paths of it count.
    """
    if not 1 <= min_hops <= max_hops:
        raise KernelValidationError("1 <= min_hops <= max_hops is needed")
    s = steps(edges, direction, relations)
    front = starts.select(F.col("start_id").cast("string").alias("start_id")).distinct()
    front = front.select("start_id", F.col("start_id").alias("end_id"), F.array("start_id").alias("node_path"), F.array().cast("array<string>").alias("relation_path"), F.array().cast("array<string>").alias("edge_path"), F.lit(0.0).alias("_sum"), F.array().cast("array<struct<relation:string,edge_id:string,next:string>>").alias("_bfs"))
    found = []
    for hop in range(1, max_hops + 1):
        front = front.join(s, F.col("end_id") == F.col("node")).where(~F.array_contains("node_path", F.col("next")))
        front = front.select(
            "start_id", F.col("next").alias("end_id"), F.concat("node_path", F.array("next")).alias("node_path"), F.concat("relation_path", F.array("relation")).alias("relation_path"), F.concat("edge_path", F.array("edge_id")).alias("edge_path"),
            (F.col("_sum") + F.col("weight")).alias("_sum"), F.concat("_bfs", F.array(F.struct("relation", "edge_id", "next"))).alias("_bfs"),
        )
        if hop >= min_hops:
            own = front if limit is None else front.orderBy("start_id", "_bfs").limit(limit + 1)
            found.append(own.withColumn("hops", F.lit(hop)))
    all_ = reduce(DataFrame.unionByName, found).withColumn("score", F.col("_sum") / F.col("hops"))
    if limit is not None:
        all_ = all_.orderBy("hops", "start_id", "_bfs").limit(limit + 1)
    return all_.select(*FIELDS, "_bfs")


class GraphSource(Source):
    """Vertices (node_id, labels, properties) and edges (edge_id, source_id, target_id, relation, weight, properties)."""

    def __init__(self, source_id: str, vertices: DataFrame, edges: DataFrame, version: str = "v1"):
        self.vertices = vertices
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        self.edges = edges
        self.ref = SourceRef(source_id, SourceKind.GRAPH)
        self.descriptor = SourceDescriptor(self.ref, frozenset({"traverse"}), EffectLevel.READ, version)
        self._snapshot = SnapshotRef(self.ref, version, None, now())

    def latest(self) -> SnapshotRef:
        return self._snapshot

    def traverse(self, op, context, starts: DataFrame | None = None) -> SourceResult:
        snap = self.snapshot(context)
        spark = self.vertices.sparkSession
        if starts is None:
            starts = spark.createDataFrame([(s,) for s in sorted(set(op.starts))], "start_id string")
        known = starts.join(self.vertices.select(F.col("node_id").cast("string").alias("_n")), F.col("start_id") == F.col("_n"), "left_semi")
        found = paths(known, self.edges, op.direction, op.relations, op.min_hops, op.max_hops, op.limit)
        first = found if op.limit is None else found.orderBy("hops", "start_id", "_bfs").limit(op.limit)
        ordered = with_order(first, F.col("hops"), F.col("node_path"), F.col("edge_path"))
        shape = F.to_json(F.struct(F.col("edge_path").alias("edges"), F.col("node_path").alias("nodes")))
        locator = F.concat(F.lit(f"graph://{self.ref.source_id}/path/"), F.sha2(shape, 256))
        evidence = evidence_frame(ordered, op.op_id, "graph", self.ref.source_id, snap.version, locator, shape, F.col("score"))
        rows = ordered.select(*FIELDS, ORDER, F.array(evidence_id(op.op_id, locator, F.lit(snap.version))).alias(IDS))

        def truncated() -> str | None:
            if op.limit is None:
                return None
            return f"more than {op.limit} paths" if found.count() > op.limit else None

        def missing() -> str | None:
            lost = starts.join(known, "start_id", "left_anti").select("start_id").distinct().orderBy("start_id").limit(20).collect()
            return f"unknown starts: {[r[0] for r in lost]}" if lost else None

        return SourceResult(ordered.drop(ORDER), Relation(FIELDS, rows, evidence), snap, checks=(missing, truncated))
