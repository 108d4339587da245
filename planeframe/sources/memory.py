"""Bi-temporal memory: recall, proposals and their atomic application."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import KernelValidationError, MemoryIdempotencyConflictError, MemoryMutationError, MemoryVersionConflictError, SnapshotUnavailableError
from ..functions.text import lexical_score
from ..model import LINK_KINDS, MEMORY_KINDS, EffectLevel, MemoryOrigin, ScopeRef, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, digest, moment, now, text
from ..operators import Relation, evidence_frame, with_order
from ..operators.relation import IDS, ORDER, evidence_id
from .base import Source, SourceResult, kept
from .history import broken
from .versions import row_mark, sum_marks

SCHEMA = (
    "memory_id string, kind string, scope struct<kind:string,scope_id:string>, content string, recorded_from timestamp, recorded_to timestamp, valid_from timestamp, valid_to timestamp,"
    " origin struct<channel:string,trace_id:string>, mutation_id string, evidence array<string>, links array<struct<kind:string,target_id:string>>, metadata map<string,string>"
)
NAMES = ("memory_id", "kind", "scope", "content", "recorded_from", "recorded_to", "valid_from", "valid_to", "origin", "mutation_id", "evidence", "links", "metadata")
FIELDS = ("memory_id", "kind", "scope_kind", "scope_id", "recorded_from", "recorded_to", "valid_from", "valid_to", "origin_channel")


def holds(lo: str, hi: str, at) -> Column:
    """Whether the half-open interval holds the time; null bounds are open."""
    at = F.lit(at)
    return (F.col(lo).isNull() | (F.col(lo) <= at)) & (F.col(hi).isNull() | (at < F.col(hi)))


def visible(records: DataFrame, known_at, valid_at) -> DataFrame:
    """Records as known at one time about what holds at another."""
    return records.where(holds("recorded_from", "recorded_to", known_at) & holds("valid_from", "valid_to", valid_at))


def recall_frame(records: DataFrame, query: str, scopes, kinds=(), known_at=None, valid_at=None, limit: int = 10) -> DataFrame:
    """The visible records in the scopes that score for the query, best first, ties by id."""
    keys = F.array(*[F.struct(F.lit(s.kind).alias("kind"), F.lit(s.scope_id).alias("scope_id")) for s in scopes])
    rows = visible(records, known_at, valid_at).where(F.array_contains(keys, F.col("scope")))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.withColumn("score", lexical_score("content", query)).where("score > 0").orderBy(F.desc("score"), "memory_id").limit(limit)


def conflict_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of the given records of which one contradicts the other, each once."""
    links = records.select("memory_id", F.explode("links").alias("l")).where("l.kind = 'contradicts'").select("memory_id", F.col("l.target_id").alias("target"))
    both = links.join(records.select(F.col("memory_id").alias("_m")), F.col("target") == F.col("_m"), "left_semi")
    return both.select(F.least("memory_id", "target").alias("id_a"), F.greatest("memory_id", "target").alias("id_b")).distinct()


def close_and_append(records: DataFrame, closed: DataFrame, new: DataFrame, at) -> DataFrame:
    """The next version: records of ``closed`` (memory_id) end at the time, ``new`` rows are added."""
    marks = closed.select(F.col("memory_id").alias("_closed")).distinct()
    old = records.join(marks, F.col("memory_id") == F.col("_closed"), "left").withColumn("recorded_to", F.when(F.col("_closed").isNotNull(), F.lit(at)).otherwise(F.col("recorded_to")))
    return old.select(*NAMES).unionByName(new.select(*NAMES))


@dataclass(frozen=True)
class Change:
    """One of assert, supersede, retract. A replacement takes over kind and links of its target."""

    action: str
    target_id: str | None = None
    kind: str | None = None
    content: str | None = None
    valid_from: datetime | None = None
    valid_to: datetime | None = None
    links: tuple[tuple[str, str], ...] = ()
    evidence: tuple[str, ...] = ()

    def __post_init__(self):
        if self.action not in ("assert", "supersede", "retract"):
            raise KernelValidationError(f"no action {self.action}")
        if (self.action == "assert") != (self.target_id is None):
            raise KernelValidationError("all but an assertion have a target")
        if self.action != "retract":
            text("content", self.content)
        if self.action == "assert" and self.kind not in MEMORY_KINDS:
            raise KernelValidationError(f"no memory kind {self.kind}")
        moment("valid_from", self.valid_from)
        moment("valid_to", self.valid_to)
        if self.valid_from and self.valid_to and self.valid_from >= self.valid_to:
            raise KernelValidationError("an interval isn't empty")
        if any(k not in LINK_KINDS or k == "supersedes" for k, _ in self.links):
            raise KernelValidationError("links are of known kinds, and 'supersedes' isn't for callers")


@dataclass(frozen=True)
class Draft:
    scope: ScopeRef
    changes: tuple[Change, ...]
    idempotency_key: str

    def __post_init__(self):
        targets = [c.target_id for c in self.changes if c.target_id]
        if not self.changes or len(targets) != len(set(targets)):
            raise KernelValidationError("a draft has changes, one for a target at most")
        text("idempotency_key", self.idempotency_key)


@dataclass(frozen=True)
class Proposal:
    proposal_id: str
    draft: Draft
    base: SnapshotRef
    origin: MemoryOrigin
    requires_approval: bool

    @property
    def approval_key(self) -> str:
        return f"memory:{self.proposal_id}"


@dataclass(frozen=True)
class Receipt:
    proposal_id: str
    version: SnapshotRef
    memory_ids: tuple[str, ...]
    reused: bool = False


class MemorySource(Source):
    """Versions of the whole history; a mutation is proposed against one version and applied to just that one."""

    def __init__(self, source_id: str, records: DataFrame, version: str = "v1", observed_at: datetime | None = None, clock: Callable[[], datetime] = now, folder: str | None = None):
        self.folder = folder
        self.ref = SourceRef(source_id, SourceKind.MEMORY)
        self.descriptor = SourceDescriptor(self.ref, frozenset({"recall", "propose_mutation", "apply_mutation"}), EffectLevel.INTERNAL_WRITE, version)
        self.clock, self.lock = clock, threading.Lock()
        self.versions = {version: records.select(*NAMES)}
        self.order = [SnapshotRef(self.ref, version, None, moment("observed_at", observed_at) or clock())]
        self.proposals: dict[str, Proposal] = {}
        self.receipts: dict[str, tuple[str, Receipt]] = {}

    def latest(self) -> SnapshotRef:
        return self.order[-1]

    def available(self) -> list[SnapshotRef]:
        return list(self.order)

    def records(self, version: str) -> DataFrame:
        """The whole history of a version."""
        return self.versions[version]

    def recall(self, op, context) -> SourceResult:
        context.require_scopes(op.scopes)
        snap = self.snapshot(context)
        known, valid = op.known_at or snap.observed_at, op.valid_at or snap.observed_at
        if known > snap.observed_at:
            raise SnapshotUnavailableError("nothing is known yet of a time after the snapshot")
        hits = with_order(recall_frame(self.records(snap.version), op.query, op.scopes, op.kinds, known, valid, op.limit), F.desc("score"), F.col("memory_id"))
        locator = F.concat(F.lit(f"memory://{self.ref.source_id}/"), F.col("memory_id"))
        interval = (F.col("valid_from"), F.col("valid_to"))
        evidence = evidence_frame(hits, op.op_id, "memory", self.ref.source_id, snap.version, locator, F.col("content"), F.col("score"), interval)
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c)
        rows = hits.select(
            "memory_id", "kind", F.col("scope.kind").alias("scope_kind"), F.col("scope.scope_id").alias("scope_id"), *map(iso, FIELDS[4:8]), F.col("origin.channel").alias("origin_channel"),
            ORDER, F.array(evidence_id(op.op_id, locator, F.lit(snap.version), *interval)).alias(IDS),
        )
        return SourceResult({"records": hits.drop(ORDER), "conflicts": conflict_pairs(hits)}, Relation(FIELDS, rows, evidence, bound=op.limit), snap)

    def _check(self, draft: Draft, records: DataFrame) -> None:
        """Targets and link targets exist in the draft's scope; targets are current."""
        wanted = [(c.target_id, True) for c in draft.changes if c.target_id] + [(t, False) for c in draft.changes for _, t in c.links]
        if not wanted:
            return
        w = records.sparkSession.createDataFrame(wanted, "id string, target boolean")
        scope = F.struct(F.lit(draft.scope.kind).alias("kind"), F.lit(draft.scope.scope_id).alias("scope_id"))
        bad = w.join(records.select("memory_id", "scope", "recorded_to"), F.col("id") == F.col("memory_id"), "left").where(F.col("memory_id").isNull() | (F.col("scope") != scope) | (F.col("target") & F.col("recorded_to").isNotNull()))
        if lost := [r["id"] for r in bad.select("id").limit(5).collect()]:
            raise MemoryMutationError(f"missing, closed or of another scope: {lost}")

    def propose_mutation(self, op, context) -> SourceResult:
        draft: Draft = op.draft
        context.require_scopes([draft.scope])
        context.require_scopes([draft.scope], write=True)
        if context.origin is None or context.origin.channel == "imported":
            raise MemoryMutationError("a proposal comes from an origin of this run")
        with self.lock:
            snap = self.snapshot(context)
            pid = digest(self.ref.source_id, draft.idempotency_key)
            if (old := self.proposals.get(pid)) is not None:
                if (old.draft, old.origin.channel) != (draft, context.origin.channel):
                    raise MemoryIdempotencyConflictError(f"{draft.idempotency_key} stands for another draft")
                return SourceResult(old, Relation((), None), snap)
            self._check(draft, self.records(snap.version))
            free = context.origin.channel == "user_explicit" and draft.scope.kind not in ("workspace", "organization")
            self.proposals[pid] = proposal = Proposal(pid, draft, snap, context.origin, not free)
        return SourceResult(proposal, Relation((), None), snap)

    def apply_mutation(self, op, context) -> SourceResult:
        proposal: Proposal = op.proposal
        draft = proposal.draft
        context.require_scopes([draft.scope], write=True)
        with self.lock:
            mark = digest(proposal)
            if (done := self.receipts.get(draft.idempotency_key)) is not None:
                if done[0] != mark:
                    raise MemoryIdempotencyConflictError(f"{draft.idempotency_key} was applied as another mutation")
                r = done[1]
                return SourceResult(Receipt(r.proposal_id, r.version, r.memory_ids, True), Relation((), None), r.version)
            if self.proposals.get(proposal.proposal_id) != proposal:
                raise MemoryMutationError("the proposal isn't from this source")
            current = self.latest()
            pin = context.pin(self.ref)
            if not current.same_version_as(proposal.base) or (pin is not None and not pin.same_version_as(current)):
                raise MemoryVersionConflictError(f"the memory is at {current.version}, the proposal at {proposal.base.version}")
            records = self.records(current.version)
            self._check(draft, records)
            at = self.clock()
            newest = records.agg(F.max(F.greatest("recorded_from", F.coalesce("recorded_to", "recorded_from")))).first()[0]
            if at <= current.observed_at or (newest is not None and at.timestamp() <= newest.timestamp()):
                raise MemoryMutationError("time must move on between versions")
            after, ids = self._after(records, draft, proposal, at)
            after = kept(after, self.folder, self.ref.source_id)
            if bad := broken(after, at, list(ids)).limit(5).collect():
                raise MemoryMutationError(f"the history would be broken: {[tuple(r) for r in bad]}")
            version = "sha256:" + after.agg(sum_marks(row_mark(after.schema))).first()[0]
            ref = SnapshotRef(self.ref, version, version.removeprefix("sha256:"), at)
            self.versions[version] = after
            self.order.append(ref)
            receipt = Receipt(proposal.proposal_id, ref, ids)
            self.receipts[draft.idempotency_key] = (mark, receipt)
        return SourceResult(receipt, Relation((), None), ref)

    def _after(self, records: DataFrame, draft: Draft, proposal: Proposal, at: datetime) -> tuple[DataFrame, tuple[str, ...]]:
        spark = records.sparkSession
        ids, new = [], []
        for i, c in enumerate(draft.changes):
            if c.action == "retract":
                continue
            mid = digest(self.ref.source_id, draft.idempotency_key, i)
            ids.append(mid)
            links = [*c.links, *([("supersedes", c.target_id)] if c.action == "supersede" else [])]
            new.append((mid, c.kind, (draft.scope.kind, draft.scope.scope_id), c.content, at, None, c.valid_from, c.valid_to, (proposal.origin.channel, proposal.origin.trace_id), proposal.proposal_id, list(c.evidence), links, {}, c.target_id if c.action == "supersede" else None))
        added = spark.createDataFrame(new, f"{SCHEMA}, _of string")
        kinds = records.select(F.col("memory_id").alias("_t"), F.col("kind").alias("_kind"))
        added = added.join(kinds, F.col("_of") == F.col("_t"), "left").withColumn("kind", F.coalesce("kind", "_kind"))
        closed = spark.createDataFrame([(c.target_id,) for c in draft.changes if c.target_id], "memory_id string")
        return close_and_append(records, closed, added, at), tuple(ids)
