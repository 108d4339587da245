"""Versioned documents: lexical search and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import KernelValidationError, SyncError
from ..functions.text import lexical_score, quoted
from ..model import EffectLevel, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, now
from ..operators import Relation, evidence_frame, with_order
from ..operators.relation import IDS, ORDER, col, evidence_id
from .base import Source, SourceResult, kept

#: Rows of searches that are read at once.
AT_ONCE = 10_000
SCHEMA = "document_id string, content string, metadata map<string,string>"


def search_frame(docs: DataFrame, query: str, limit: int, filters: dict | None = None) -> DataFrame:
    """(document_id, content, metadata, score): filter on metadata, score, keep what scores, best first, ties by id.

    A filter value of null matches a missing key. One scan; the order is a
    top-k, so nothing but ``limit`` rows per task is shuffled.
    """
    for key, value in sorted((filters or {}).items()):
        docs = docs.where(F.try_element_at("metadata", F.lit(key)).eqNullSafe(F.lit(None if value is None else str(value)).cast("string")))
    return docs.withColumn("score", lexical_score("content", query)).where("score > 0").orderBy(F.desc("score"), "document_id").limit(limit)


def search_frames(docs: DataFrame, asked: list[tuple[str, int, dict | None]]) -> DataFrame:
    """(query, document_id, content, metadata, score): what ``search_frame`` gives for each (text, limit, filters), by one scan.

    Each document is scored for all queries where it lies. A task hands on the
    best ``limit`` rows of each query; the best of these are the result.
    """
    scores = []
    for text, _, filters in asked:
        fits = F.lit(True)
        for key, value in sorted((filters or {}).items()):
            fits = fits & F.try_element_at("metadata", F.lit(key)).eqNullSafe(F.lit(None if value is None else str(value)).cast("string"))
        scores.append(F.when(fits, lexical_score("content", text)).otherwise(0.0))
    scored = docs.select("document_id", "content", "metadata", F.posexplode(F.array(*scores)).alias("query", "score")).where("score > 0")
    limit = F.element_at(F.array(*[F.lit(n) for _, n, _ in asked]), F.col("query") + 1)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "document_id"))
    # a constant bound lets tasks cut their rows before they are shuffled
    best = scored.withColumn("_place", place).where(F.col("_place") <= max(n for _, n, _ in asked))
    return best.where(F.col("_place") <= limit).select("query", "document_id", "content", "metadata", "score")


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after a change set: (kind add/update/delete, document_id, content, metadata); one row per document."""
    b, c = base.alias("b"), changes.alias("c")
    return (
        b.join(c, F.col("b.document_id") == F.col("c.document_id"), "full_outer")
        .where("c.kind IS NULL OR c.kind <> 'delete'")
        .select(*[F.when(F.col("c.kind").isNull(), F.col(f"b.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in ("document_id", "content", "metadata")])
    )


def conflicts(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that can't be applied: additions of present documents, updates and deletions of missing ones."""
    here = base.select("document_id", F.lit(True).alias("_here"))
    return changes.join(here, "document_id", "left").where("(kind = 'add') = coalesce(_here, false)")


def state_version(docs: DataFrame) -> str:
    """A checksum of a state that doesn't depend on partitions or order: sums of row hashes, hashed."""
    row = F.sha2(F.to_json(F.struct("document_id", "content", F.array_sort(F.map_entries("metadata")).alias("m"))), 256)
    part = [F.sum(F.conv(F.substring(row, i * 15 + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return docs.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit("0")) for p in part]), 256)).first()[0]


class DocumentSource(Source):
    """Documents (document_id, content, metadata) by version; old versions stay readable.

    A version that a change set makes is stored, in ``folder`` if one is given. Every name of metadata becomes a field.
    """

    def __init__(self, source_id: str, documents: DataFrame, version: str, folder: str | None = None):
        self.folder = folder
        self.ref = SourceRef(source_id, SourceKind.DOCUMENT)
        self.descriptor = SourceDescriptor(self.ref, frozenset({"search", "sync"}), EffectLevel.READ, version)
        self.versions: dict[str, tuple[DataFrame, list[str]]] = {}
        self.order: list[SnapshotRef] = []
        self._add(version, documents, None)

    def _add(self, version: str, docs: DataFrame, checksum: str | None) -> SnapshotRef:
        docs = docs.select(F.col("document_id").cast("string").alias("document_id"), F.col("content").cast("string").alias("content"), F.coalesce(F.col("metadata").cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))
        self.versions[version] = (docs, self._keys(docs))
        ref = SnapshotRef(self.ref, version, checksum, now())
        self.order = [s for s in self.order if s.version != version] + [ref]
        return ref

    @staticmethod
    def _keys(docs: DataFrame) -> list[str]:
        return sorted(r[0] for r in docs.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().collect())

    def state(self, version: str) -> tuple[DataFrame, list[str]]:
        """The documents of a version, and the names of their metadata."""
        return self.versions[version]

    def latest(self) -> SnapshotRef:
        return self.order[-1]

    def available(self) -> list[SnapshotRef]:
        return list(self.order)

    def hits(self, version: str, asked: list[tuple[str, int, dict | None]]) -> DataFrame:
        """(query, document_id, content, metadata, score) for each (text, limit, filters), by one scan of the version."""
        return search_frames(self.state(version)[0], asked)

    def search(self, op, context) -> SourceResult:
        return self.search_all([op], context)[0]

    def search_all(self, ops: list, context) -> list[SourceResult]:
        """The results of several searches of one version, from one scan.

        Up to ``AT_ONCE`` rows are read at once, so that what follows (a fusion, a
        join, the evidence) reads them and not the documents again.
        """
        snap = self.snapshot(context)
        _, keys = self.state(snap.version)
        found = self.hits(snap.version, [(o.query, o.limit, o.filters) for o in ops])
        if sum(o.limit for o in ops) <= AT_ONCE:
            got = found.toArrow()
            spark = found.sparkSession
            found = spark.createDataFrame(got, schema=found.schema) if got.num_rows else spark.createDataFrame([], found.schema)
        return [self._result(found.where(F.col("query") == k).drop("query"), o, snap, keys) for k, o in enumerate(ops)]

    def _result(self, found: DataFrame, op, snap: SnapshotRef, keys: list[str]) -> SourceResult:
        hits = with_order(found, F.desc("score"), F.col("document_id"))
        locator = F.concat(F.lit(f"document://{self.ref.source_id}/"), quoted("document_id"))
        evidence = evidence_frame(hits, op.op_id, "document", self.ref.source_id, snap.version, locator, F.col("content"), F.col("score"), metadata=F.col("metadata"))
        fields = ["document_id", "score", *(f"metadata.{k}" for k in keys)]
        named = hits.select("document_id", "score", *[F.try_element_at("metadata", F.lit(k)).alias(f"metadata.{k}") for k in keys], ORDER, locator.alias("_l"))
        rows = named.select(*map(col, fields), ORDER, F.array(evidence_id(op.op_id, F.col("_l"), F.lit(snap.version))).alias(IDS))
        return SourceResult(hits.orderBy(ORDER).drop(ORDER), Relation(tuple(fields), rows, evidence, bound=op.limit), snap)

    def sync(self, changes: DataFrame) -> SnapshotRef:
        """Apply a change set to the latest version; content that was there before is the version it was."""
        docs, _ = self.versions[self.latest().version]
        if changes.groupBy("document_id").count().where("count > 1").limit(1).count():
            raise KernelValidationError("a change set has one change for a document")
        if bad := conflicts(docs, changes).select("kind", "document_id").limit(5).collect():
            raise SyncError(f"can't apply {[tuple(r) for r in bad]}")
        after = kept(apply_changes(docs, changes), self.folder, self.ref.source_id)
        version = "sha256:" + state_version(after)
        if version in self.versions:
            self.order.sort(key=lambda s: s.version == version)
            return self.latest()
        return self._add(version, after, version.removeprefix("sha256:"))
