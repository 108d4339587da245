"""Document and memory sources whose versions, change sets and receipts are kept in a shared folder."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import KernelValidationError, MemoryIdempotencyConflictError, MemoryMutationError, MemoryVersionConflictError, SyncError, VersionConflictError
from ..model import SnapshotRef, digest
from ..operators import Relation
from .base import SourceResult
from .document import DocumentSource, apply_changes, conflicts
from .history import broken
from .memory import NAMES, MemorySource, Proposal, Receipt
from .postings import Postings, Segment
from .versions import BUCKETS, Commit, Versions


class StoredDocuments(DocumentSource):
    """Documents in ``folder``, shared by all engines that open it: a restarted engine finds the versions and receipts of the one before.

    With ``index`` a version is searched by posting blocks, which a change set extends.
    """

    def __init__(self, spark: SparkSession, source_id: str, folder: str, documents: DataFrame | None = None, buckets: int = BUCKETS, index: bool = False):
        self.spark, self.root, self.indexed = spark, folder.rstrip("/"), index
        cast = lambda d: d.select(F.col("document_id").cast("string").alias("document_id"), F.col("content").cast("string").alias("content"), F.coalesce(F.col("metadata").cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))
        empty = spark.createDataFrame([], "document_id string, content string, metadata map<string,string>")
        self.store = Versions(spark, self.root, empty.schema, "document_id")
        if not self.store.commits:
            if documents is None:
                raise KernelValidationError(f"there are no documents in {folder}")
            docs = cast(documents)
            self.store = Versions.create(docs, self.root, "document_id", buckets, index=_told(Postings.build(docs, f"{self.root}/index")) if index else None)
        self.postings: dict[str, Postings] = {}
        super().__init__(source_id, self.store.rows(), self.store.head().version)
        self.known: dict[str, list[str]] = {self.store.head().version: self.versions[self.store.head().version][1]}

    def _ref(self, c: Commit) -> SnapshotRef:
        return SnapshotRef(self.ref, c.version, c.version.removeprefix("sha256:"), c.at)

    def latest(self) -> SnapshotRef:
        return self._ref(self.store.head())

    def available(self) -> list[SnapshotRef]:
        return [self._ref(c) for c in self.store.log()]

    def state(self, version: str) -> tuple[DataFrame, list[str]]:
        rows = self.store.rows(self.store.at(version))
        if version not in self.known:
            self.known[version] = self._keys(rows)
        return rows, self.known[version]

    def hits(self, version: str, asked: list[tuple[str, int, dict | None]]) -> DataFrame:
        told = self.store.at(version).more.get("index")
        if not told:
            return super().hits(version, asked)
        if version not in self.postings:
            self.postings[version] = _index(self.spark, f"{self.root}/index", told)
        return self.postings[version].search_many(asked)

    def receipt(self, key: str) -> tuple[str, str, SnapshotRef] | None:
        """(fingerprint of the change set, version before, version after) of a key that was applied, by whichever engine."""
        c = self.store.receipt(key)
        return None if c is None else (c.mark, c.before, self._ref(c))

    def commit(self, changes: DataFrame, key: str, mark: str, base: str | None) -> tuple[str, SnapshotRef, bool]:
        """Apply a change set under its key: (version before, version after, whether it had been applied)."""
        if changes.groupBy("document_id").count().where("count > 1").limit(1).count():
            raise KernelValidationError("a change set has one change for a document")
        changes = changes.select("kind", F.col("document_id").cast("string").alias("document_id"), F.col("content").cast("string").alias("content"), F.coalesce(F.col("metadata").cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))
        more: dict = {}

        def change(rows: DataFrame, head: Commit) -> DataFrame:
            if bad := conflicts(rows, changes).select("kind", "document_id").limit(5).collect():
                raise SyncError(f"can't apply {[tuple(r) for r in bad]}")
            if head.more.get("index"):
                more["index"] = _told(_index(self.spark, f"{self.root}/index", head.more["index"]).extended(changes))
            return apply_changes(rows, changes)

        done, reused = self.store.commit(changes.select("document_id"), change, key, mark, base, more=more)
        return done.before, self._ref(done), reused

    def sync(self, changes: DataFrame) -> SnapshotRef:
        return self.commit(changes, f"unnamed:{digest(self.latest().version, self.store.head().number)}", "", self.latest().version)[1]


def _told(p: Postings) -> str:
    return json.dumps([[s.path.removeprefix(p.folder + "/"), s.dead and s.dead.removeprefix(p.folder + "/")] for s in p.segments])


def _index(spark: SparkSession, folder: str, told: str) -> Postings:
    return Postings(spark, folder, tuple(Segment(f"{folder}/{p}", d and f"{folder}/{d}") for p, d in json.loads(told)))


class StoredMemory(MemorySource):
    """A memory in ``folder``: versions by content, receipts that outlive the engine, mutations that rewrite the buckets of the memories they touch.

    Proposals wait in the process that made them; a proposal that was applied is
    known to all. Before a mutation is committed the histories that it touches
    are checked (see ``history``).
    """

    def __init__(self, source_id: str, records: DataFrame, folder: str, buckets: int = BUCKETS, **more):
        records = records.select(*NAMES)
        newest = lambda: _iso(records.agg(F.max(F.greatest("recorded_from", F.coalesce("recorded_to", "recorded_from")))).first()[0])
        observed = more.get("observed_at")
        self.store = Versions(records.sparkSession, folder, records.schema, "memory_id")
        if not self.store.commits:
            if bad := broken(records, observed).limit(5).collect():
                raise KernelValidationError(f"the history is broken: {[tuple(r) for r in bad]}")
            self.store = Versions.create(records, folder, "memory_id", buckets, at=observed, newest=newest())
        super().__init__(source_id, self.store.rows(), self.store.head().version, **more)

    def _ref(self, c: Commit) -> SnapshotRef:
        return SnapshotRef(self.ref, c.version, c.version.removeprefix("sha256:"), c.at)

    def latest(self) -> SnapshotRef:
        return self._ref(self.store.head())

    def available(self) -> list[SnapshotRef]:
        return [self._ref(c) for c in self.store.log()]

    def records(self, version: str) -> DataFrame:
        return self.store.rows(self.store.at(version))

    def apply_mutation(self, op, context) -> SourceResult:
        proposal: Proposal = op.proposal
        draft = proposal.draft
        context.require_scopes([draft.scope], write=True)
        spark = self.store.spark
        with self.lock:
            mark = digest(proposal)
            if (old := self.store.receipt(draft.idempotency_key)) is not None:
                if old.mark != mark:
                    raise MemoryIdempotencyConflictError(f"{draft.idempotency_key} was applied as another mutation")
                return self._receipt(proposal, old, True)
            if self.proposals.get(proposal.proposal_id) != proposal:
                raise MemoryMutationError("the proposal isn't from this source")
            pin = context.pin(self.ref)
            if pin is not None and not pin.same_version_as(self.latest()):
                raise MemoryVersionConflictError(f"the memory is at {self.latest().version}, the context at {pin.version}")
            at = self.clock()
            made = [digest(self.ref.source_id, draft.idempotency_key, i) for i, c in enumerate(draft.changes) if c.action != "retract"]
            named = [c.target_id for c in draft.changes if c.target_id] + [t for c in draft.changes for _, t in c.links]
            ids = spark.createDataFrame([(i,) for i in {*made, *named}], "memory_id string")

            def change(rows: DataFrame, head: Commit) -> DataFrame:
                self._check(draft, rows)
                newest = head.more.get("newest")
                if at <= head.at or (newest and at <= datetime.fromisoformat(newest)):
                    raise MemoryMutationError("time must move on between versions")
                after, _ = self._after(rows, draft, proposal, at)
                if bad := broken(after, links_of=made).limit(5).collect():
                    raise MemoryMutationError(f"the history would be broken: {[tuple(r) for r in bad]}")
                return after

            try:
                done, reused = self.store.commit(ids, change, draft.idempotency_key, mark, proposal.base.version, at, {"newest": _iso(at), "ids": made})
            except VersionConflictError as e:
                raise MemoryVersionConflictError(str(e)) from None
            return self._receipt(proposal, done, reused)

    def _receipt(self, proposal: Proposal, done: Commit, reused: bool) -> SourceResult:
        ref = self._ref(done)
        return SourceResult(Receipt(proposal.proposal_id, ref, tuple(done.more["ids"]), reused), Relation((), None), ref)


def _iso(t: datetime | None) -> str | None:
    return None if t is None else (t if t.tzinfo else t.replace(tzinfo=UTC)).isoformat()
