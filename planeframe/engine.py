"""The engine: checks a plan, lowers it to one lazy frame per operation, runs writes in order, records and replays."""

from __future__ import annotations

import threading
import time
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators
from .audit import Outcome, OutcomeLog, ResolutionLog, ResultStore, TraceLog, frame_fingerprint
from .errors import (
    ArtifactIntegrityError,
    BudgetExceeded,
    DeadlineExceeded,
    DuplicateSourceError,
    ExecutionError,
    IdempotencyConflictError,
    KernelError,
    PlanValidationError,
    ReplayError,
    SnapshotUnavailableError,
    SourceExecutionError,
    UnsupportedOutcomeError,
    UnsupportedPlanningError,
    UnsupportedSyncError,
    VersionConflictError,
)
from .model import Context, EffectLevel, ResultKind, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, Usage, digest, now
from .operators.relation import IDS, ORDER, Relation, col
from .plans import Issue, Plan, Ref, plan_from_json, plan_to_json, topological_order, validate
from .plans.operations import DATAFLOW, Operation
from .sources.base import Source, SourceResult


@dataclass(frozen=True)
class Envelope:
    """A result with its views; frames are lazy until they are read."""

    op_id: str
    value: Any
    result_kind: ResultKind
    trace_id: str
    relation: Relation
    snapshots: tuple[SnapshotRef, ...] = ()
    usage: Usage = field(default_factory=Usage)
    checks: tuple = ()
    partial: tuple = ()

    def bindings(self) -> DataFrame:
        return self.relation.public()

    @property
    def evidence(self) -> DataFrame | None:
        return self.relation.evidence

    def finalize(self) -> tuple[str, tuple[str, ...]]:
        """(status, warnings): runs the counts that warnings need."""
        soft = [w for c in self.checks if (w := c())]
        hard = [w for c in self.partial if (w := c())]
        return ("partial" if hard else "ok"), (*soft, *hard)

    def replayed(self, value: Any, relation: Relation) -> Envelope:
        return replace(self, value=value, relation=relation)


class Catalog:
    """Sources by id."""

    def __init__(self, *sources: Source):
        self.sources: dict[str, Source] = {}
        for s in sources:
            self.register(s)

    def register(self, source: Source) -> None:
        """Add a source; its id must be new."""
        if (name := source.descriptor.ref.source_id) in self.sources:
            raise DuplicateSourceError(f"there is a source {name}")
        self.sources[name] = source

    def descriptors(self) -> dict[str, SourceDescriptor]:
        return {k: s.descriptor for k, s in self.sources.items()}

    def get(self, ref: SourceRef) -> Source:
        s = self.sources.get(ref.source_id)
        if s is None or s.descriptor.ref != ref:
            raise ExecutionError(f"no {ref.kind.value} source {ref.source_id}")
        return s

    def frame(self, spark: SparkSession, kinds=(), allowed=frozenset()) -> DataFrame:
        """The catalog as rows, by id: (source_id, kind, capabilities, max_effect, version)."""
        rows = [(d.ref.source_id, d.ref.kind.value, sorted(d.capabilities), d.max_effect.name, self.sources[i].latest().version) for i, d in sorted(self.descriptors().items())]
        df = spark.createDataFrame(rows, "source_id string, kind string, capabilities array<string>, max_effect string, version string")
        if kinds:
            df = df.where(F.col("kind").isin(*[SourceKind(k).value for k in kinds]))
        if allowed:
            df = df.where(F.col("source_id").isin(*sorted(allowed)))
        return df.orderBy("source_id")


@dataclass(frozen=True)
class ChangeSet:
    """Changes (kind, document_id, content, metadata, checksum) of one source against one of its versions."""

    source: SourceRef
    changes: DataFrame
    idempotency_key: str
    base_version: str | None = None
    protocol: str = "1"


@dataclass(frozen=True)
class SyncReceipt:
    source: SourceRef
    before: str
    after: SnapshotRef
    reused: bool = False


@dataclass(frozen=True)
class Attempt:
    plan: Plan
    result: Envelope | None
    error: str | None


@dataclass(frozen=True)
class Resolution:
    text: str
    attempts: tuple[Attempt, ...]
    calls: int
    usage: Usage = field(default_factory=Usage)

    @property
    def result(self) -> Envelope:
        return self.attempts[-1].result


class Engine:
    """Runs plans over a catalog. Sources' frames stay lazy, so Catalyst sees a plan's dataflow as one tree."""

    def __init__(self, spark: SparkSession, catalog: Catalog, traces: TraceLog | None = None, results: ResultStore | None = None, compiler: Any = None, outcomes: OutcomeLog | None = None, resolutions: ResolutionLog | None = None):
        self.spark, self.catalog, self.traces, self.results, self.compiler, self.outcomes = spark, catalog, traces, results, compiler, outcomes
        self.resolutions = resolutions
        self.synced: dict[str, tuple[str, SyncReceipt]] = {}
        self.plans: dict[str, tuple[Plan, str, dict[str, str], str]] = {}

    # --- execution

    def execute(self, what: Operation | Plan, context: Context | None = None) -> Envelope:
        context = context or Context()
        plan = what if isinstance(what, Plan) else Plan((what,), Ref(what.op_id), max_effect=what.effect.level)
        mark = digest(plan_to_json(plan))
        if self.traces:
            self.traces.add(context.trace_id, "plan_started", plan=mark, operations=len(plan.operations))
        try:
            with stopped_at(self.spark, context):
                done, marks = self._run(plan, context)
            env = self._select(done, plan.output)
            if self.traces:
                final = self._mark(env)
                self.traces.add(context.trace_id, "plan_completed", result=final)
                self.plans[context.trace_id] = (plan, mark, marks, final)
                if self.results:
                    self.results.save_plan(context.trace_id, plan_to_json(plan), marks, final)
            return env
        except Exception as e:
            if self.traces:
                self.traces.add(context.trace_id, "plan_failed", kind=failure_kind(e), error=type(e).__name__)
            raise

    def _preflight(self, plan: Plan, context: Context) -> None:
        _deadline(context)
        if issues := validate(plan, self.catalog.descriptors(), None):
            over = [i for i in issues if i.code == "budget_exceeded"]
            if over and len(over) == len(issues):
                raise BudgetExceeded(over[0].message)
            raise PlanValidationError(issues)
        context.budget.require(Usage(actions=len(plan.operations)))
        for o in plan.operations:
            context.require(o.effect)
            if o.name == "recall":
                context.require_scopes(o.scopes)
            if o.name in ("propose_mutation", "apply_mutation"):
                context.require_scopes([(o.draft if o.name == "propose_mutation" else o.proposal.draft).scope], write=True)
            ref = getattr(o, "source", None)
            if ref is not None and o.name != "describe":
                self.catalog.get(ref).snapshot(context)

    def _run(self, plan: Plan, context: Context) -> tuple[dict[str, Envelope], dict[str, str]]:
        self._preflight(plan, context)
        ops = {o.op_id: o for o in plan.operations}
        done: dict[str, Envelope] = {}
        marks: dict[str, str] = {}
        usage = Usage()
        ahead: dict[str, SourceResult] = {}
        for k in topological_order(plan):
            _deadline(context)
            o = ops[k]
            began = time.monotonic()
            if self.traces:
                self.traces.add(context.trace_id, "operation_started", op_id=k, operation=o.name)
            env = self._one(o, context, done, ahead, [x for x in plan.operations if x.op_id not in done])
            own = Usage(actions=1, latency_ms=int(1000 * (time.monotonic() - began)))
            usage = usage + own
            context.budget.require(usage)
            plan.budget.require(usage)
            if env.result_kind != o.output:
                raise ExecutionError(f"{k} gave a {env.result_kind.value}")
            for s in env.snapshots:
                pin = context.pin(s.source)
                if pin is not None and o.name != "apply_mutation" and not pin.same_version_as(s):
                    raise SnapshotUnavailableError(f"{s.source.source_id} served {s.version}, not {pin.version}")
            done[k] = replace(env, usage=usage)
            if self.traces:
                if self.results and o.name not in DATAFLOW:
                    marks[k] = self.results.save(context.trace_id, k, env.relation.rows, env.relation.evidence)
                self.traces.add(context.trace_id, "operation_completed", op_id=k, result=marks.get(k))
        return done, marks

    def _one(self, o: Operation, context: Context, done: Mapping[str, Envelope], ahead: dict[str, SourceResult], left: list[Operation]) -> Envelope:
        """Run one operation. A plan's searches of one source share a scan: ``ahead`` keeps the results of those whose turn comes later."""
        make = lambda value, relation, **more: Envelope(o.op_id, value, o.output, context.trace_id, relation, **more)
        if o.name == "discover":
            df = self.catalog.frame(self.spark, o.kinds, context.allowed_resources)
            return make(df, Relation((), None))
        if o.name == "describe":
            return make(self.catalog.get(o.source).descriptor, Relation((), None))
        if o.name in DATAFLOW:
            return self._dataflow(o, context, done)
        source = self.catalog.get(o.source)
        args = self._bound(o, done)
        try:
            if o.name == "search" and o.op_id not in ahead and "search_all" in dir(type(source)):
                same = [x for x in left if x.name == "search" and x.source == o.source]
                ahead.update(zip([x.op_id for x in same], source.search_all(same, context), strict=True))
            r: SourceResult = ahead.pop(o.op_id) if o.op_id in ahead else getattr(source, o.name)(o, context, *args)
        except KernelError:
            raise
        except Exception as e:
            raise SourceExecutionError(f"{o.source.source_id} failed: {type(e).__name__}") from e
        inputs = [done[x.op_id] for x in o.refs]
        snaps = _unique([*(s for i in inputs for s in i.snapshots), *([r.snapshot] if r.snapshot else [])])
        return make(r.value, r.relation, snapshots=snaps, usage=r.usage, checks=(*r.checks, *(c for i in inputs for c in i.checks)), partial=(*r.partial, *(c for i in inputs for c in i.partial)))

    def _bound(self, o: Operation, done: Mapping[str, Envelope]) -> tuple:
        if o.name == "traverse" and o.start_binding is not None:
            b = o.start_binding
            rows = _field(done, b)
            if rows.schema[0].dataType.typeName() != "string":
                raise ExecutionError("starts must be strings")
            if b.cardinality == "single":
                starts = [_single(rows, b)]
                return (self.spark.createDataFrame([(s,) for s in starts], "start_id string"),)
            starts = rows.select(col(b.field).alias("start_id")).distinct()  # stays distributed
            n = starts.limit(b.max_items + 1).count()
            if n > b.max_items or not n:
                raise ExecutionError(f"a binding of 1..{b.max_items} starts has {'none' if not n else 'more'}")
            if starts.where("start_id IS NULL OR trim(start_id) = ''").limit(1).count():
                raise ExecutionError("starts must not be blank")
            return (starts,)
        if o.name == "invoke_skill":
            return ({name: _single(_field(done, b), b) if b.cardinality == "single" else _collect(_field(done, b), b) for name, b in o.argument_bindings},)
        return ()

    def _dataflow(self, o: Operation, context: Context, done: Mapping[str, Envelope]) -> Envelope:
        inputs = [done[r.op_id] for r in o.inputs]
        rel = [i.relation for i in inputs]
        value: Any
        if o.name == "project":
            out = operators.project(rel[0], o.fields)
        elif o.name == "filter":
            out = operators.filter_rows(rel[0], o.field, o.operator, o.value)
        elif o.name == "join":
            out = operators.join_rows(rel[0], rel[1], o.left_on, o.right_on, o.left_alias, o.right_alias)
        else:
            frames, bounds = [r.evidence for r in rel if r.evidence is not None], [r.bound for r in rel if r.evidence is not None]
            if o.name == "fuse":
                if not frames:
                    raise ExecutionError("there is no evidence to fuse")
                evidence = operators.fuse(frames, o.limit, o.rank_constant, bounds)
            else:
                evidence = operators.compose_evidence(frames) if frames else None
            bound = o.limit if o.name == "fuse" else None if None in bounds else sum(bounds)
            out = Relation((), None, evidence, bound)
        if o.name == "compose":
            value = [_select(i.value, r.path) for i, r in zip(inputs, o.inputs, strict=True)]
        else:
            value = out.evidence if o.name == "fuse" else out.rows
        snaps = _unique([s for i in inputs for s in i.snapshots])
        return Envelope(o.op_id, value, o.output, context.trace_id, out, snaps, checks=tuple(c for i in inputs for c in i.checks), partial=tuple(c for i in inputs for c in i.partial))

    def _select(self, done: Mapping[str, Envelope], ref: Ref) -> Envelope:
        env = done[ref.op_id]
        return replace(env, value=_select(env.value, ref.path)) if ref.path else env

    def _mark(self, env: Envelope) -> str:
        r = env.relation
        return digest([None if df is None else frame_fingerprint(df) for df in (r.rows, r.evidence)], env.result_kind.value)

    # --- replay

    def replay(self, trace_id: str) -> Envelope:
        """Run the dataflow again over recorded source results; every fingerprint must be as it was."""
        if self.traces is None or self.results is None:
            raise ReplayError("nothing is recorded")
        events = self.traces.get(trace_id)
        if not any(e["event"] == "plan_completed" for e in events):
            raise ReplayError("only completed plans can be replayed")
        if trace_id not in self.plans:  # another process ran it
            told, marks, final = self.results.load_plan(trace_id)
            self.plans[trace_id] = (plan := plan_from_json(told), digest(plan_to_json(plan)), marks, final)
        plan, mark, marks, final = self.plans[trace_id]
        if digest(plan_to_json(plan)) != mark or events[0]["plan"] != mark:
            raise ReplayError("the plan isn't the one that ran")
        self.traces.add(trace_id, "replay_started")
        try:
            done: dict[str, Envelope] = {}
            ops = {o.op_id: o for o in plan.operations}
            context = Context(trace_id=trace_id)
            for k in topological_order(plan):
                o = ops[k]
                if o.name in DATAFLOW:
                    done[k] = self._dataflow(o, context, done)
                    continue
                rows, evidence, found = self.results.load(trace_id, k)
                if found != marks[k]:
                    raise ReplayError(f"the recorded result of {k} has changed")
                fields = tuple(c for c in rows.columns if c not in (ORDER, IDS)) if rows is not None else ()
                done[k] = Envelope(k, rows, o.output, trace_id, Relation(fields, rows, evidence))
            env = self._select(done, plan.output)
            if self._mark(env) != final:
                raise ReplayError("the result differs")
        except Exception:
            self.traces.add(trace_id, "replay_failed")
            raise
        self.traces.add(trace_id, "replay_completed")
        return env

    # --- change sets, mutations, outcomes

    def sync(self, change_set: ChangeSet) -> SyncReceipt:
        source = self.catalog.get(change_set.source)
        if "sync" not in source.descriptor.capabilities:
            raise UnsupportedSyncError(f"{change_set.source.source_id} takes no change sets")
        if change_set.protocol != "1":
            raise UnsupportedSyncError("another protocol")
        changes = change_set.changes
        mark = digest(frame_fingerprint(changes), change_set.base_version)
        durable = getattr(source, "receipt", None)  # of a source that keeps its own receipts, for all engines
        old = self.synced.get(change_set.idempotency_key)
        if durable is not None and (told := durable(change_set.idempotency_key)) is not None:
            old = (told[0], SyncReceipt(change_set.source, told[1], told[2]))
        if old is not None:
            if old[0] != mark:
                raise IdempotencyConflictError(f"{change_set.idempotency_key} stands for another change set")
            return replace(old[1], reused=True)
        before = source.latest().version
        if change_set.base_version is not None and change_set.base_version != before:
            raise VersionConflictError(f"the source is at {before}, the change set at {change_set.base_version}")
        if "checksum" in changes.columns:
            if changes.where("kind <> 'delete' AND checksum IS NOT NULL AND checksum <> sha2(content, 256)").limit(1).count():
                raise ArtifactIntegrityError("an artifact's content doesn't have its checksum")
        if not changes.limit(1).count():
            raise ExecutionError("a change set has changes")
        if durable is not None:
            return SyncReceipt(change_set.source, *source.commit(changes, change_set.idempotency_key, mark, change_set.base_version))
        receipt = SyncReceipt(change_set.source, before, source.sync(changes))
        self.synced[change_set.idempotency_key] = (mark, receipt)
        return receipt

    def knows(self, source: SourceRef, key: str) -> bool:
        """Whether a change set of this key was applied: by this engine, or by any if the source keeps receipts."""
        durable = getattr(self.catalog.get(source), "receipt", None)
        return key in self.synced or durable is not None and durable(key) is not None

    def apply(self, proposal: Any, context: Context) -> Envelope:
        from .plans import ApplyMutation

        return self.execute(ApplyMutation(source=proposal.base.source, proposal=proposal), replace(context, max_effect=max(context.max_effect, EffectLevel.INTERNAL_WRITE)))

    def record_outcome(self, outcome: Outcome) -> Outcome:
        if self.outcomes is None:
            raise UnsupportedOutcomeError("there is no outcome log")
        return self.outcomes.record(outcome)

    # --- intent to plan

    def resolve(self, text: str, context: Context | None = None) -> Resolution:
        """Compile and run; one more plan if a source failed and nothing could have been written."""
        if self.compiler is None:
            raise UnsupportedPlanningError("there is no compiler")
        context = context or Context()
        context = replace(context, max_effect=min(context.max_effect, EffectLevel.READ))
        view = self._planning_view(context)
        attempts: list[Attempt] = []
        calls, failure, spent = 0, None, Usage()
        log = lambda event, n=None, **d: self.resolutions and self.resolutions.add(context.trace_id, event, n, **d)
        log("resolution_started", text=digest(text))
        for n in range(2):
            try:
                left = replace(context, budget=context.budget.remaining(spent))
                plan, used, took = self.compiler.compile(text, view, left, failure)
            except Exception as e:
                log("resolution_failed", error=type(e).__name__)
                raise
            calls, spent = calls + used, spent + took
            log("attempt_started", n, plan=digest(plan_to_json(plan)))
            try:
                env = self.execute(plan, replace(context, trace_id=f"{context.trace_id}:{n}"))
            except Exception as e:
                attempts.append(Attempt(plan, None, failure_kind(e)))
                log("attempt_failed", n, error=failure_kind(e))
                reads = all(o.effect.level <= EffectLevel.READ for o in plan.operations)
                if failure_kind(e) != "source" or not reads or n:
                    log("resolution_failed", error=type(e).__name__)
                    raise
                failure = "source"
                continue
            attempts.append(Attempt(plan, env, None))
            log("attempt_completed", n)
            log("resolution_completed")
            return Resolution(text, tuple(attempts), calls, spent)
        raise AssertionError

    def _planning_view(self, context: Context) -> dict[str, dict]:
        """What a planner may see: no metadata, nothing that writes, only what is allowed."""
        out = {}
        for i, d in sorted(self.catalog.descriptors().items()):
            if context.allowed_resources and i not in context.allowed_resources:
                continue
            out[i] = {"kind": d.ref.kind.value, "operations": sorted(d.capabilities - {"apply_mutation", "sync"})}
            if d.ref.kind == SourceKind.SKILL:
                out[i]["skills"] = [s.ref.__dict__ for s, _ in self.catalog.sources[i].skills.values() if s.effect <= EffectLevel.READ and not s.requires_approval]
        return out


def failure_kind(e: Exception) -> str:
    """Only a failed source makes another plan worth trying."""
    if isinstance(e, SourceExecutionError):
        return "source"
    if isinstance(e, DeadlineExceeded):
        return "deadline"
    if isinstance(e, BudgetExceeded):
        return "budget"
    if isinstance(e, PlanValidationError):
        return "validation"
    if isinstance(e, PermissionError):
        return "policy"
    return "execution" if isinstance(e, KernelError) else "internal"


@contextmanager
def stopped_at(spark: SparkSession, context: Context):
    """Cancel the jobs that run in here when the deadline comes; what they raise then is that it has passed."""
    if context.deadline is None:
        yield
        return
    sc, name = spark.sparkContext, f"deadline:{context.trace_id}"
    sc.setJobGroup(name, name, True)
    watch = threading.Timer(max(0.0, (context.deadline - now()).total_seconds()), sc.cancelJobGroup, (name,))
    watch.daemon = True
    watch.start()
    try:
        yield
    except KernelError as e:
        if not isinstance(e, SourceExecutionError):
            raise
        _deadline(context)
        raise
    except Exception:
        _deadline(context)
        raise
    finally:
        watch.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def _deadline(context: Context) -> None:
    if context.deadline is not None and now() >= context.deadline:
        raise DeadlineExceeded("the deadline has passed")


def _unique(snaps) -> tuple[SnapshotRef, ...]:
    out: dict[str, SnapshotRef] = {}
    for s in snaps:
        out[s.source.source_id] = s
    return tuple(out.values())


def _select(value: Any, path) -> Any:
    """Mapping key, sequence index, attribute, or column, step by step."""
    for step in path:
        if isinstance(value, Mapping) and step in value:
            value = value[step]
        elif isinstance(value, list | tuple) and isinstance(step, int) and -len(value) <= step < len(value):
            value = value[step]
        elif isinstance(value, DataFrame) and step in value.columns:
            value = value.select(col(str(step)))
        elif isinstance(step, str) and not step.startswith("_") and hasattr(value, "__dataclass_fields__") and step in value.__dataclass_fields__:
            value = getattr(value, step)
        else:
            raise ExecutionError(f"the value has no {step!r}")
    return value


def _field(done: Mapping[str, Envelope], b) -> DataFrame:
    r = done[b.ref.op_id].relation
    if b.field not in r.fields:
        raise ExecutionError(f"no field {b.field}; there are {list(r.fields)}")
    return r.rows.select(col(b.field), ORDER)


def _single(rows: DataFrame, b) -> Any:
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise ExecutionError(f"{b.field} needs exactly one row, there are {'none' if not got else 'more'}")
    return got[0][0]


def _collect(rows: DataFrame, b) -> list:
    """The distinct values in row order; more than the binding allows is an error."""
    kind = rows.schema[0].dataType.typeName()
    if kind in ("array", "struct", "map"):
        raise ExecutionError("only scalars can be collected")
    got = rows.groupBy(col(b.field)).agg(F.min(ORDER).alias("_o")).orderBy("_o").limit(b.max_items + 1).collect()
    if len(got) > b.max_items:
        raise ExecutionError(f"{b.field} has more than {b.max_items} distinct values")
    return [r[0] for r in got]


__all__ = ["Attempt", "Catalog", "ChangeSet", "Engine", "Envelope", "Issue", "Resolution", "SyncReceipt", "failure_kind"]
