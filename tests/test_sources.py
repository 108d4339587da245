"""Graph, memory, skill, table and document sources."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from planeframe.engine import Catalog, ChangeSet, Engine
from planeframe.errors import (
    ArtifactIntegrityError,
    EffectPolicyError,
    ExecutionError,
    IdempotencyConflictError,
    KernelValidationError,
    MemoryIdempotencyConflictError,
    MemoryMutationError,
    MemoryVersionConflictError,
    ScopePolicyError,
    SnapshotUnavailableError,
    SyncError,
    VersionConflictError,
)
from planeframe.model import Context, EffectLevel, MemoryOrigin, ScopeRef, SnapshotRef
from planeframe.plans import InvokeSkill, ProposeMutation, Query, Recall, ResolveSkill, Search, Traverse
from planeframe.sources import DocumentSource, GraphSource, MemorySource, SkillSource, SkillSpec, TableSource
from planeframe.sources.graph import paths
from planeframe.sources.memory import SCHEMA, Change, Draft

EDGE = "edge_id string, source_id string, target_id string, relation string, weight double"


def bfs_model(edges, starts, direction, low, high, limit):
    """Breadth-first search with sorted starts and steps; stops after limit + 1 accepted paths."""
    step = {}
    for e, s, t, r, w in edges:
        if direction in ("out", "both"):
            step.setdefault(s, []).append((r, e, t, w))
        if direction in ("in", "both") and not (direction == "both" and s == t):
            step.setdefault(t, []).append((r, e, s, w))
    queue = [((s,), (), 0.0) for s in sorted(set(starts))]
    out = []
    while queue and len(out) <= limit:
        nodes, es, total = queue.pop(0)
        if len(es) >= low:
            out.append((len(es), nodes, es, total / len(es)))
        if len(es) < high:
            queue += [((*nodes, t), (*es, e), total + w) for r, e, t, w in sorted(step.get(nodes[-1], [])) if t not in nodes]
    return sorted(out[: limit + 1])[: limit + 1]


@pytest.mark.parametrize("seed", range(6))
def test_traversal_matches_model(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(6)]
    edges = [(f"e{i}", rnd.choice(nodes), rnd.choice(nodes), rnd.choice("xy"), float(rnd.randint(1, 4))) for i in range(14)]
    direction, low, high, limit = rnd.choice(["out", "in", "both"]), rnd.choice([1, 2]), 3, rnd.choice([3, 7, 500])
    starts = rnd.sample(nodes, 2)
    found = paths(spark.createDataFrame([(s,) for s in starts], "start_id string"), spark.createDataFrame(edges, EDGE), direction, (), low, high, limit)
    got = sorted((r["hops"], tuple(r["node_path"]), tuple(r["edge_path"]), r["score"]) for r in found.collect())
    assert got == bfs_model(edges, starts, direction, low, high, limit)


def test_traverse_source(spark):
    edges = [("e1", "Ann", "Acme", "works_at", 1.0), ("e2", "Acme", "Shanghai", "located_in", 1.0), ("e3", "Shanghai", "China", "in_country", 1.0)]
    g = GraphSource("g", spark.createDataFrame([(n,) for n in ("Ann", "Acme", "Shanghai", "China")], "node_id string"), spark.createDataFrame(edges, EDGE))
    env = Engine(spark, Catalog(g)).execute(Traverse(source=g.ref, starts=("Acme", "Nobody"), max_hops=2))
    assert [r["end_id"] for r in env.bindings().collect()] == ["Shanghai", "China"]
    status, warnings = env.finalize()
    assert status == "ok"
    assert "Nobody" in warnings[0]
    assert env.evidence.count() == 2


def day(n):
    return datetime(2026, 1, n, tzinfo=UTC)


ORG, ME = ScopeRef("workspace", "w"), ScopeRef("principal", "alice")


def memory(spark, clock=None):
    def rec(mid, kind, scope, content, since, until=None, valid=None, links=()):
        return (mid, kind, (scope.kind, scope.scope_id), content, day(since), until and day(until), valid and day(valid), None, ("imported", None), None, [], list(links), {})

    rows = [
        rec("v1", "fact", ORG, "supplier approved once", 1, 10, 1), rec("v2", "fact", ORG, "supplier approved twice", 10, None, 5, [("supersedes", "v1")]),
        rec("email", "preference", ME, "preference is email", 2), rec("phone", "preference", ME, "preference is phone", 3, None, None, [("contradicts", "email")]),
    ]
    return MemorySource("m", spark.createDataFrame(rows, SCHEMA), observed_at=day(12), clock=clock or (lambda: day(13)))


def test_recall_in_two_times(spark):
    m = memory(spark)
    engine, ctx = Engine(spark, Catalog(m)), Context(readable_scopes=frozenset({ORG, ME}))
    ask = lambda **k: [r["memory_id"] for r in engine.execute(Recall(source=m.ref, query="supplier approved", scopes=(ORG,), **k), ctx).bindings().collect()]
    assert ask(valid_at=day(7), known_at=day(7)) == ["v1"]
    assert ask(valid_at=day(7), known_at=day(11)) == ["v2"]
    both = engine.execute(Recall(source=m.ref, query="preference", scopes=(ME,)), ctx).value
    assert [tuple(r) for r in both["conflicts"].collect()] == [("email", "phone")]
    with pytest.raises(SnapshotUnavailableError):
        ask(known_at=day(20))
    with pytest.raises(ScopePolicyError):
        engine.execute(Recall(source=m.ref, query="x", scopes=(ScopeRef("session", "s"),)), ctx)


def test_memory_mutations(spark):
    ticks = iter(range(13, 28))
    m = memory(spark, lambda: day(next(ticks)))
    engine = Engine(spark, Catalog(m))
    ctx = Context(readable_scopes=frozenset({ME}), writable_scopes=frozenset({ME}), origin=MemoryOrigin("user_explicit", "t"))
    draft = Draft(ME, (Change("supersede", "email", content="preference is letter"), Change("assert", kind="fact", content="likes tea", links=(("supports", "phone"),)), Change("retract", "phone")), "k1")
    p = engine.execute(ProposeMutation(source=m.ref, draft=draft), ctx).value
    assert not p.requires_approval
    assert engine.execute(ProposeMutation(source=m.ref, draft=draft), ctx).value is p
    with pytest.raises(MemoryIdempotencyConflictError):
        engine.execute(ProposeMutation(source=m.ref, draft=Draft(ME, (Change("retract", "email"),), "k1")), ctx)
    stale = engine.execute(ProposeMutation(source=m.ref, draft=Draft(ME, (Change("retract", "email"),), "k2")), ctx).value
    receipt = engine.apply(p, ctx).value
    assert len(receipt.memory_ids) == 2
    assert engine.apply(p, ctx).value.reused
    with pytest.raises(MemoryVersionConflictError):
        engine.apply(stale, ctx)
    now = engine.execute(Recall(source=m.ref, query="preference tea", scopes=(ME,)), ctx).value["records"]
    assert sorted((r["content"], r["kind"]) for r in now.collect()) == [("likes tea", "fact"), ("preference is letter", "preference")]
    past = Context(readable_scopes=frozenset({ME}), snapshots=(SnapshotRef(m.ref, "v1"),))
    assert sorted(r["memory_id"] for r in engine.execute(Recall(source=m.ref, query="preference", scopes=(ME,)), past).bindings().collect()) == ["email", "phone"]
    with pytest.raises(MemoryMutationError):
        engine.execute(ProposeMutation(source=m.ref, draft=Draft(ME, (Change("retract", "v1"),), "k3")), ctx)
    with pytest.raises(KernelValidationError):
        Draft(ME, (Change("retract", "a"), Change("retract", "a")), "k")


def test_skills(spark):
    label = SkillSpec("risk-label", "1.0.0", "label risk", input_schema={"required": ["risk"], "additionalProperties": False, "properties": {"risk": {"type": "string"}}}, output_schema={"properties": {"label": {"type": "string"}}})
    read = SkillSpec("review", "1.0.0", "review policy", "Read.", "instruction")
    danger = SkillSpec("record", "1.0.0", "record approval", effect=EffectLevel.INTERNAL_WRITE, requires_approval=True)
    s = SkillSource(spark, "s", [(label, lambda a, c: {"label": a["risk"].upper()}), (read, None), (danger, lambda a, c: {})])
    engine = Engine(spark, Catalog(s))
    assert engine.execute(ResolveSkill(source=s.ref, query="risk-label")).bindings().first()["score"] == 3.0
    env = engine.execute(InvokeSkill(source=s.ref, skill=label.ref, arguments={"risk": "critical"}))
    assert env.bindings().first()["output.label"] == "CRITICAL"
    for bad in ({}, {"risk": 1}, {"risk": "a", "x": 1}):
        with pytest.raises(ExecutionError):
            engine.execute(InvokeSkill(source=s.ref, skill=label.ref, arguments=bad))
    with pytest.raises(ExecutionError, match="reading only"):
        engine.execute(InvokeSkill(source=s.ref, skill=read.ref))
    op = InvokeSkill(source=s.ref, skill=danger.ref, governed_effect=EffectLevel.INTERNAL_WRITE, requires_approval=True, approval_key="yes")
    with pytest.raises(EffectPolicyError):
        engine.execute(op, Context(max_effect=EffectLevel.INTERNAL_WRITE))
    assert engine.execute(op, Context(max_effect=EffectLevel.INTERNAL_WRITE, approvals=frozenset({"yes"}))).value == {}


@pytest.mark.parametrize(
    "statement",
    ["DROP TABLE t", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SET x = 1", "CACHE TABLE t", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/tmp/x`", "SELECT 1; SELECT 2", "SELECT * FROM other", "EXPLAIN SELECT 1",
     "SELECT transform(a) USING 'cat' FROM t", "SELECT * FROM t WHERE a IN (SELECT b FROM secret)", "EXECUTE IMMEDIATE 'SELECT 1'", "SHOW TABLES"],
)
def test_only_reading_statements(spark, statement):
    t = TableSource(spark, "w", {"t": spark.range(3).toDF("a")})
    with pytest.raises(ExecutionError):
        t.frame(statement)


def test_query(spark):
    t = TableSource(spark, "w", {"t": spark.range(30).toDF("a")}, row_limit=10)
    engine = Engine(spark, Catalog(t))
    env = engine.execute(Query(source=t.ref, statement="WITH x AS (SELECT a FROM t WHERE a < :top) SELECT a, a * 2 AS b FROM x WHERE a NOT IN (SELECT a FROM t WHERE a = 1) ORDER BY a", parameters={"top": 5}))
    assert [tuple(r) for r in env.bindings().collect()] == [(0, 0), (2, 4), (3, 6), (4, 8)]
    assert env.finalize() == ("ok", ())
    assert engine.execute(Query(source=t.ref, statement="SELECT a FROM t")).finalize()[0] == "partial"
    same = engine.execute(Query(source=t.ref, statement="SELECT 1 AS a FROM t LIMIT 4"))
    assert same.evidence.select("evidence_id").distinct().count() == 4
    with pytest.raises(ExecutionError):
        engine.execute(Query(source=t.ref, statement="SELECT 1", language="cypher"))


DOC = "document_id string, content string, metadata map<string,string>"


def kb(spark):
    return DocumentSource("kb", spark.createDataFrame([("travel", "Meals up to 100 dollars", {"department": "sales"}), ("keys", "Hardware keys", {"x y": "z"})], DOC), "v1")


def test_search(spark):
    s = kb(spark)
    env = Engine(spark, Catalog(s)).execute(Search(source=s.ref, query="meals", filters={"department": "sales"}))
    assert env.bindings().collect()[0].asDict() == {"document_id": "travel", "score": 1.0, "metadata.department": "sales", "metadata.x y": None}
    env = Engine(spark, Catalog(s)).execute(Search(source=s.ref, query="keys meals", filters={"department": None}))
    assert [r["document_id"] for r in env.bindings().collect()] == ["keys"]


def test_sync(spark):
    s = kb(spark)
    engine = Engine(spark, Catalog(s))
    row = lambda kind, i, content=None: spark.createDataFrame([(kind, i, content, {"d": "e"})], "kind string, document_id string, content string, metadata map<string,string>")
    change = ChangeSet(s.ref, row("update", "travel", "Meals up to 50 dollars"), "c1", "v1")
    receipt = engine.sync(change)
    assert engine.sync(change).reused
    with pytest.raises(IdempotencyConflictError):
        engine.sync(ChangeSet(s.ref, row("delete", "travel"), "c1", "v1"))
    with pytest.raises(VersionConflictError):
        engine.sync(ChangeSet(s.ref, row("delete", "travel"), "c2", "v1"))
    with pytest.raises(SyncError):
        engine.sync(ChangeSet(s.ref, row("add", "travel", "x"), "c3"))
    with pytest.raises(SyncError):
        engine.sync(ChangeSet(s.ref, row("delete", "nothing"), "c4"))
    text = lambda ctx=None: engine.execute(Search(source=s.ref, query="meals"), ctx).value.first()["content"]
    assert "50" in text()
    assert "100" in text(Context(snapshots=(SnapshotRef(s.ref, "v1"),)))
    with pytest.raises(SnapshotUnavailableError):
        text(Context(snapshots=(SnapshotRef(s.ref, "v9"),)))
    bad = spark.createDataFrame([("add", "n", "text", {}, "00")], "kind string, document_id string, content string, metadata map<string,string>, checksum string")
    with pytest.raises(ArtifactIntegrityError):
        engine.sync(ChangeSet(s.ref, bad, "c5"))
    back = engine.sync(ChangeSet(s.ref, row("add", "tmp", "t"), "c6")).after
    assert engine.sync(ChangeSet(s.ref, row("delete", "tmp"), "c7")).after.version == receipt.after.version != back.version


def test_sync_stream(spark, tmp_path):
    from planeframe.streaming import sync_stream

    s = kb(spark)
    engine = Engine(spark, Catalog(s))
    schema = "kind string, document_id string, content string, metadata map<string,string>, sequence long"
    spark.createDataFrame([("update", "travel", "old", {}, 1), ("update", "travel", "new rule", {}, 2), ("add", "more", "rule", {}, 3)], schema).write.parquet(str(tmp_path / "in"))
    q = sync_stream(engine, s, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    hits = engine.execute(Search(source=s.ref, query="rule")).value
    assert sorted(r["document_id"] for r in hits.collect()) == ["more", "travel"]


def test_deadline_and_interval():
    with pytest.raises(KernelValidationError):
        Change("assert", kind="fact", content="x", valid_from=day(2), valid_to=day(2))
    assert day(2) - day(1) == timedelta(days=1)
