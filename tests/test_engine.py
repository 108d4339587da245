"""Plans, their validation and codec, execution policy, traces, replay, outcomes, compilation."""

from dataclasses import replace
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest

from planeframe.audit import Assertion, Outcome, OutcomeLog, ResolutionLog, ResultStore, TraceLog
from planeframe.compiler import Answer, Compiler, ScriptedModel, StructuredModel
from planeframe.engine import Catalog, Engine
from planeframe.errors import (
    BudgetExceeded,
    DeadlineExceeded,
    DuplicateSourceError,
    EffectPolicyError,
    ExecutionError,
    KernelValidationError,
    OutcomeConflictError,
    PlanCompilationError,
    PlanValidationError,
    ReplayError,
    SerializationError,
    SnapshotUnavailableError,
    SourceExecutionError,
    TraceConflictError,
    TraceError,
    TraceNotFoundError,
    UnsupportedPlanningError,
)
from planeframe.faults import FlakySource
from planeframe.model import Budget, Context, EffectLevel, EffectSpec, ScopeRef, SourceRef, Usage
from planeframe.plans import Binding, Compose, Describe, Discover, Filter, Fuse, InvokeSkill, Join, Plan, Project, ProposeMutation, Query, Recall, Ref, ResolveSkill, Search, Traverse, plan_from_json, plan_to_dict, plan_to_json, topological_order, validate
from planeframe.sources import DocumentSource, GraphSource, TableSource
from planeframe.sources.memory import Change, Draft
from planeframe.sources.skill import SkillRef

KB, WH = SourceRef("kb", "document"), SourceRef("wh", "table")


@pytest.fixture
def sources(spark):
    docs = spark.createDataFrame([("travel", "Meals and hotels are reimbursable", {"department": "sales"}), ("keys", "Hardware keys", {"department": "security"})], "document_id string, content string, metadata map<string,string>")
    spend = spark.createDataFrame([(7, "sales", "meal", 80.0), (7, "sales", "hotel", 600.0), (8, "security", "meal", 50.0)], "employee long, department string, category string, amount double")
    return DocumentSource("kb", docs, "v1"), TableSource(spark, "wh", {"spend": spend})


def joined():
    return Plan(
        (
            Search(op_id="s", source=KB, query="meals reimbursable"),
            Query(op_id="q", source=WH, statement="SELECT department, sum(amount) AS amount FROM spend GROUP BY department"),
            Project(op_id="ps", inputs=(Ref("s"),), fields=("document_id", "metadata.department")),
            Project(op_id="pq", inputs=(Ref("q"),), fields=("department", "amount")),
            Filter(op_id="f", inputs=(Ref("pq"),), field="amount", operator="gt", value=60),
            Join(op_id="j", inputs=(Ref("ps"), Ref("f")), left_on=("metadata.department",), right_on=("department",), left_alias="policy", right_alias="expense"),
        ),
        Ref("j"),
    )


def test_join_across_surfaces(spark, sources):
    env = Engine(spark, Catalog(*sources)).execute(joined())
    assert [r.asDict() for r in env.bindings().collect()] == [{"policy.document_id": "travel", "policy.metadata.department": "sales", "expense.department": "sales", "expense.amount": 680.0}]
    assert sorted(r[0] for r in env.evidence.select("source_id").collect()) == ["kb", "wh"]
    assert {s.source.source_id for s in env.snapshots} == {"kb", "wh"}
    assert env.usage.actions == 6


def test_bound_traversal_compose_and_paths(spark, sources):
    g = GraphSource("g", spark.createDataFrame([("Acme",), ("Shanghai",)], "node_id string"), spark.createDataFrame([("e", "Acme", "Shanghai", "in")], "edge_id string, source_id string, target_id string, relation string"))
    engine = Engine(spark, Catalog(*sources, g))
    ask = lambda sql, **b: engine.execute(Plan((Query(op_id="q", source=WH, statement=sql), Traverse(op_id="t", source=g.ref, start_binding=Binding(Ref("q"), "x", **b))), Ref("t"))).bindings().collect()
    assert ask("SELECT 'Acme' AS x")[0]["end_id"] == "Shanghai"
    assert len(ask("SELECT 'Acme' AS x FROM spend", cardinality="collect")) == 1
    with pytest.raises(ExecutionError, match="exactly one"):
        ask("SELECT 'Acme' AS x FROM spend")
    with pytest.raises(ExecutionError, match="more"):
        ask("SELECT category AS x FROM spend", cardinality="collect", max_items=1)
    env = engine.execute(Plan((Describe(op_id="d", source=KB), Search(op_id="s", source=KB, query="keys"), Search(op_id="u", source=KB, query="keys"), Compose(op_id="c", inputs=(Ref("d", ("version",)), Ref("s"), Ref("u", ("content",))))), Ref("c")))
    assert env.value[0] == "v1"
    assert env.evidence.count() == 2  # one row read by two operations keeps two ids
    fused = engine.execute(Plan((Search(op_id="s", source=KB, query="keys"), Search(op_id="u", source=KB, query="hardware"), Fuse(op_id="f", inputs=(Ref("s"), Ref("u")))), Ref("f")))
    assert fused.evidence.count() == 1  # of one provenance
    assert [r["source_id"] for r in engine.execute(Discover(kinds=("document",))).value.collect()] == ["kb"]


def test_codec_round_trip():
    ops = (
        Discover(op_id="a", kinds=("table",)), Describe(op_id="b", source=KB), Search(op_id="c", source=KB, query="q", filters={"x": None}), Query(op_id="d", source=WH, statement="SELECT 1", parameters={"a": [1, "b"]}),
        Traverse(op_id="e", source=SourceRef("g", "graph"), start_binding=Binding(Ref("d"), "x", "collect", 7)), Recall(op_id="f", source=SourceRef("m", "memory"), query="q", scopes=(ScopeRef("session", "s"),), kinds=("fact",), valid_at=datetime(2026, 1, 1, tzinfo=UTC)),
        ResolveSkill(op_id="g", source=SourceRef("k", "skill"), query="q"), InvokeSkill(op_id="h", source=SourceRef("k", "skill"), skill=SkillRef("n", "1", "d"), argument_bindings=(("a", Binding(Ref("d"), "x")),), arguments={"b": 1}),
        ProposeMutation(op_id="i", source=SourceRef("m", "memory"), draft=Draft(ScopeRef("session", "s"), (Change("assert", kind="fact", content="c"),), "k")), Project(op_id="j", inputs=(Ref("d"),), fields=("a",)),
        Filter(op_id="k", inputs=(Ref("j"),), field="a", operator="in", value=(1, 2)), Join(op_id="l", inputs=(Ref("j"), Ref("k")), left_on=("a",), right_on=("a",)), Fuse(op_id="m", inputs=(Ref("c"),)), Compose(op_id="n", inputs=(Ref("d", ("x", 0)),)),
    )
    plan = Plan(ops, Ref("n"), budget=Budget(max_cost_usd=Decimal("1.5"), max_actions=3))
    again = plan_from_json(plan_to_json(plan))
    assert plan_to_dict(again) == plan_to_dict(plan)
    assert again.budget == plan.budget
    for bad in ("{", "[]", '{"schema": "x"}', plan_to_json(plan).replace('"search"', '"steal"'), plan_to_json(plan).replace('"op_id": "c"', '"op_id": "c", "zzz": 1')):
        with pytest.raises(SerializationError):
            plan_from_json(bad)


def test_validation_codes(sources):
    s = lambda i, **k: Search(op_id=i, source=k.pop("source", KB), query="q", **k)
    catalog = Catalog(*sources).descriptors()
    codes = lambda *ops, out="a", **k: {i.code for i in validate(Plan(ops, Ref(out), **k), catalog)}
    assert codes(s("a")) == set()
    assert "duplicate_op_id" in codes(s("a"), s("a"))
    assert "missing_plan_output" in codes(s("a"), out="z")
    assert "input_count_mismatch" in codes(Join(op_id="a", inputs=(Ref("b"),), left_on=("x",), right_on=("x",)), s("b"))
    assert "missing_input" in codes(Project(op_id="a", inputs=(Ref("z"),), fields=("x",)))
    assert "self_reference" in codes(Project(op_id="a", inputs=(Ref("a"),), fields=("x",)))
    assert "incompatible_input_kind" in codes(Filter(op_id="a", inputs=(Ref("b"),), field="x", operator="eq", value=1), s("b"))
    assert "unsupported_input_path" in codes(Project(op_id="a", inputs=(Ref("b", ("x",)),), fields=("x",)), s("b"))
    assert "effect_exceeds_plan" in codes(s("a"), max_effect=EffectLevel.PURE)
    assert "unknown_source" in codes(s("a", source=SourceRef("zz", "document")))
    assert "source_identity_mismatch" in codes(s("a", source=SourceRef("wh", "document")))
    assert "unsupported_operation" in {i.code for i in validate(Plan((s("a"),), Ref("a")), {"kb": replace(catalog["kb"], capabilities=frozenset())})}
    assert "effect_exceeds_source" in {i.code for i in validate(Plan((s("a"),), Ref("a")), {"kb": replace(catalog["kb"], max_effect=EffectLevel.PURE)})}
    assert "budget_exceeded" in codes(s("a"), Compose(op_id="b", inputs=(Ref("a"),)), out="b", budget=Budget(max_actions=1))
    assert "cyclic_plan" in codes(Project(op_id="a", inputs=(Ref("b"),), fields=("x",)), Project(op_id="b", inputs=(Ref("a"),), fields=("x",)))
    assert "unreachable_operation" in codes(s("a"), s("b"))
    assert topological_order(Plan((Project(op_id="p", inputs=(Ref("a"),), fields=("x",)), s("a"), s("b")), Ref("p"))) == ["a", "p", "b"]
    with pytest.raises(KernelValidationError):
        Search(source=WH, query="x")


def test_policy(spark, sources):
    engine = Engine(spark, Catalog(*sources))
    search = Search(source=KB, query="keys")
    with pytest.raises(EffectPolicyError):
        engine.execute(search, Context(allowed_resources=frozenset({"wh"})))
    with pytest.raises(DeadlineExceeded):
        engine.execute(search, Context(deadline=datetime(2020, 1, 1, tzinfo=UTC)))
    with pytest.raises(BudgetExceeded):
        engine.execute(joined(), Context(budget=Budget(max_actions=5)))
    with pytest.raises(PlanValidationError):
        engine.execute(Plan((search,), Ref("nothing")))
    assert EffectSpec(EffectLevel.EXTERNAL_WRITE).violations(Context(max_effect=EffectLevel.EXTERNAL_WRITE)) == ("an external write needs an idempotency key",)
    with pytest.raises(KernelValidationError):
        EffectSpec(EffectLevel.DESTRUCTIVE)
    assert Budget(max_actions=3).remaining(Usage(actions=5)).max_actions == 0


def test_trace_and_replay(spark, sources, tmp_path):
    log = TraceLog(str(tmp_path / "trace.jsonl"))
    engine = Engine(spark, Catalog(*sources), log, ResultStore(spark, str(tmp_path / "results")))
    engine.execute(joined(), Context(trace_id="t1"))
    events = log.get("t1")
    assert [e["sequence"] for e in events] == list(range(len(events)))
    assert (events[0]["event"], events[-1]["event"]) == ("plan_started", "plan_completed")
    assert "reimbursable" not in (tmp_path / "trace.jsonl").read_text()
    assert engine.replay("t1").relation.rows.count() == 1
    assert len(TraceLog(str(tmp_path / "trace.jsonl")).get("t1")) == len(log.get("t1"))
    with pytest.raises(TraceConflictError):
        engine.execute(joined(), Context(trace_id="t1"))
    engine.results.known["t1", "q"] = {**engine.results.known["t1", "q"]}
    spark.createDataFrame([("sales", 1.0, 0, ["x"])], "department string, amount double, _ord long, _evidence_ids array<string>").write.mode("overwrite").parquet(engine.results._path("t1", "q", "rows"))
    with pytest.raises(ReplayError):
        engine.replay("t1")
    assert spark.read.json(str(tmp_path / "trace.jsonl")).where("event = 'replay_failed'").count() == 1


def test_resolve_replans_once(spark, sources, tmp_path):
    draft = lambda i: {"operations": [{"type": "search", "op_id": i, "source": "kb", "query": "keys", "filters_json": "{}"}], "output": i}
    wrong = {"operations": [{"type": "search", "op_id": "a", "source": "nowhere", "query": "q"}], "output": "a"}
    log = TraceLog()
    model = ScriptedModel([wrong, draft("one"), draft("two")])
    said = ResolutionLog(str(tmp_path / "r.jsonl"))
    engine = Engine(spark, Catalog(FlakySource(sources[0], {"search": (1,)}), sources[1]), log, compiler=Compiler(model), resolutions=said)
    got = engine.resolve("find keys", Context(trace_id="r"))
    assert [a.error for a in got.attempts] == ["source", None]
    assert got.calls == 3
    assert [(e["event"], e["attempt"]) for e in said.events["r"]][1:-1] == [("attempt_started", 0), ("attempt_failed", 0), ("attempt_started", 1), ("attempt_completed", 1)]
    with pytest.raises(TraceError):
        said.add("r", "attempt_started", 2)
    assert model.requests[1]["problems"]
    assert model.requests[2]["failure"] == "source"
    assert log.get("r:0")[-1]["event"] == "plan_failed"
    with pytest.raises(SourceExecutionError):
        Engine(spark, Catalog(FlakySource(sources[0], {"search": (1,)}))).execute(Search(source=KB, query="x"))
    with pytest.raises(PlanCompilationError):
        Engine(spark, Catalog(*sources), compiler=Compiler(ScriptedModel([wrong, wrong]))).resolve("x")
    with pytest.raises(UnsupportedPlanningError):
        Engine(spark, Catalog(*sources)).resolve("x")


def test_outcomes(spark, sources, tmp_path):
    engine = Engine(spark, Catalog(*sources), outcomes=OutcomeLog(str(tmp_path / "o.jsonl")))
    o = Outcome("o1", "t1", "task", "me", (Assertion("a", True, Decimal("0.5")), Assertion("b", False)), datetime(2026, 1, 1, tzinfo=UTC), "k")
    assert engine.record_outcome(o) is engine.record_outcome(o)
    assert not o.succeeded
    with pytest.raises(OutcomeConflictError):
        engine.record_outcome(replace(o, task="other"))
    assert engine.outcomes.list("t1") == [o]
    with pytest.raises(KernelValidationError):
        replace(o, succeeded=True)


def test_catalog_refuses_a_second_source_of_an_id(sources):
    with pytest.raises(DuplicateSourceError):
        Catalog(*sources).register(sources[0])


def test_changed_files_are_another_version(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    wh = TableSource(spark, "wh", {"t": path})
    engine, pinned = Engine(spark, Catalog(wh)), wh.latest()
    ask = lambda **k: engine.execute(Query(source=WH, statement="SELECT count(*) AS n FROM t"), Context(**k)).bindings().first()[0]
    assert ask(snapshots=(pinned,)) == 3
    spark.range(2).write.mode("append").parquet(path)
    with pytest.raises(SnapshotUnavailableError):
        ask(snapshots=(pinned,))
    assert ask() == 5


def test_table_that_changes_while_it_is_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    wh = TableSource(spark, "wh", {"t": path})
    versions = iter([wh._version(), "data:other"])
    monkeypatch.setattr(wh, "_version", lambda: next(versions, "data:other"))
    with pytest.raises(SnapshotUnavailableError, match="changed while"):
        wh.query(Query(source=WH, statement="SELECT id FROM t"), Context())


def test_failed_reads_are_failures_of_the_source(spark, sources):
    with pytest.raises(SourceExecutionError):
        Engine(spark, Catalog(*sources)).execute(Query(source=WH, statement="SELECT raise_error('x') AS a FROM spend"))


def test_deadline_stops_running_work(spark, sources):
    slow = "SELECT count(*) AS n FROM range(400000) a JOIN range(400000) b ON a.id <> b.id WHERE sha2(cast(a.id * b.id AS string), 256) = 'x'"
    began = datetime.now(UTC)
    with pytest.raises(DeadlineExceeded):
        Engine(spark, Catalog(*sources)).execute(Query(source=WH, statement=slow), Context(deadline=began + timedelta(seconds=3)))
    assert datetime.now(UTC) - began < timedelta(seconds=60)


def test_logs_and_replay_outlive_the_process(spark, sources, tmp_path):
    path = lambda n: str(tmp_path / n)
    one = Outcome("o", "t", "task", "judge", (Assertion("a", True, Decimal("0.5")),), datetime(2026, 1, 1, tzinfo=UTC), "k")
    OutcomeLog(path("outcomes")).record(one)
    again = OutcomeLog(path("outcomes"))
    assert again.record(one) == again.get("o") == one
    with pytest.raises(OutcomeConflictError):
        again.record(replace(one, task="other"))
    log = ResolutionLog(path("resolutions"))
    log.add("r", "resolution_started")
    log.add("r", "attempt_started", 0)
    with pytest.raises(TraceError):
        ResolutionLog(path("resolutions")).add("r", "resolution_completed")
    Engine(spark, Catalog(*sources), TraceLog(path("traces")), ResultStore(spark, path("results"))).execute(joined(), Context(trace_id="t"))
    later = Engine(spark, Catalog(), TraceLog(path("traces")), ResultStore(spark, path("results")))
    assert later.replay("t").bindings().count() == 1
    assert TraceLog(path("traces")).get("t")[-1]["event"] == "replay_completed"
    with pytest.raises(TraceNotFoundError):
        later.replay("never")


def test_versions_of_documents_are_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", {})], "document_id string, content string, metadata map<string,string>")
    source = DocumentSource("kb", docs, "v1", folder=str(tmp_path))
    after = source.sync(spark.createDataFrame([("add", "b", "y", {"k": "v"})], "kind string, document_id string, content string, metadata map<string,string>"))
    frame = source.versions[after.version][0]
    assert str(tmp_path) in frame.inputFiles()[0]
    assert sorted(r[0] for r in frame.select("document_id").collect()) == ["a", "b"]


def test_models_are_measured_and_faults_are_counted(spark, sources):
    draft = {"operations": [{"type": "search", "op_id": "s", "source": "kb", "query": "keys"}], "output": "s"}
    with pytest.raises(BudgetExceeded):
        Engine(spark, Catalog(*sources), compiler=Compiler(ScriptedModel([Answer(draft, Usage(tokens=9))]))).resolve("x", Context(budget=Budget(max_tokens=8)))
    with pytest.raises(PlanCompilationError):
        StructuredModel(lambda request: ("[1]", 1, Decimal(0)))({})
    with pytest.raises(PlanCompilationError):
        StructuredModel(lambda request: ("{", 1, Decimal(0)))({})
    flaky = FlakySource(sources[0], {"search": (2,)})
    engine, search = Engine(spark, Catalog(flaky)), Search(source=KB, query="keys")
    engine.execute(search)
    with pytest.raises(SourceExecutionError):
        engine.execute(search)
    engine.execute(search)
    assert flaky.calls["search"] == 3
    for bad in ({}, {"search": (0,)}, {"query": (1,)}):
        with pytest.raises(KernelValidationError):
            FlakySource(sources[0], bad)
