"""Queries that run operations, writes, recordings and policies through the engine, with their SQL."""

from __future__ import annotations

import json
import tempfile
from dataclasses import replace
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import Assertion, Outcome, OutcomeLog, ResultStore, TraceLog
from .compiler import Compiler, StructuredModel
from .engine import Catalog, ChangeSet, Engine
from .errors import KernelError
from .faults import FlakySource
from .lifecycle import ArtifactStore
from .model import Budget, Context, EffectLevel, MemoryOrigin, ScopeRef, SourceRef
from .operators.relation import col
from .plans import Binding, Compose, Describe, Discover, Filter, Fuse, InvokeSkill, Join, Plan, Project, ProposeMutation, Query, Recall, Ref, ResolveSkill, Search, Traverse, validate
from .queries import AT, CHANGED, LATE, MEMORIES, _CLICK, _search_sql, _told, _walk, documents, edges, memories, query, skills, table
from .sources import DocumentSource, GraphSource, MemorySource, TableSource
from .sources.memory import Change, Draft


def folder(spark: SparkSession) -> str:
    """A new folder for recordings: in the cluster's shared one, in a temporary one where none is set, as in tests."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/records-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="planeframe-")


def kb(spark: SparkSession, sf_dir: str) -> DocumentSource:
    return DocumentSource("kb", documents(spark, sf_dir), "v1")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableSource:
    """Whole tables, without a limit of rows."""
    return TableSource(spark, "warehouse", {n: f"{sf_dir}/{n}.parquet" for n in names}, row_limit=None)


def graph(spark: SparkSession, sf_dir: str) -> GraphSource:
    e = edges(spark, sf_dir)
    return GraphSource("graph", e.select(F.col("source_id").alias("node_id")).union(e.select("target_id")).distinct(), e)


def memory(spark: SparkSession, sf_dir: str) -> MemorySource:
    return MemorySource("memory", memories(spark, sf_dir), observed_at=AT, clock=lambda: LATE)


def everything(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(kb(spark, sf_dir), tables(spark, sf_dir, "nation", "region", "customer"), graph(spark, sf_dir), memory(spark, sf_dir), skills(spark))


def refused(f) -> str:
    """The name of the error that a call raises."""
    try:
        f()
    except KernelError as e:
        return type(e).__name__
    return "none"


def pairs(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({names})"


# --- operations


@query(pairs("('graph', 'graph'), ('kb', 'document'), ('memory', 'memory'), ('skills', 'skill'), ('warehouse', 'table')", "source_id, kind"))
def engine_discover(spark, sf_dir) -> DataFrame:
    return Engine(spark, everything(spark, sf_dir)).execute(Discover()).value.select("source_id", "kind")


@query(pairs("('kb', 'document'), ('warehouse', 'table')", "source_id, kind"))
def engine_discover_kinds(spark, sf_dir) -> DataFrame:
    return Engine(spark, everything(spark, sf_dir)).execute(Discover(kinds=("document", "table"))).value.select("source_id", "kind")


@query(pairs("('kb', 'search'), ('kb', 'sync'), ('memory', 'apply_mutation'), ('memory', 'propose_mutation'), ('memory', 'recall'), ('warehouse', 'query')", "source_id, operation"))
def engine_describe(spark, sf_dir) -> DataFrame:
    engine = Engine(spark, everything(spark, sf_dir))
    told = [engine.execute(Describe(source=engine.catalog.sources[s].descriptor.ref)).value for s in ("kb", "memory", "warehouse")]
    return spark.createDataFrame([(d.ref.source_id, c) for d in told for c in d.capabilities], "source_id string, operation string")


@query(_search_sql("heat tion stupid", "documents", "doc_id::VARCHAR", "text", "lang = 'en'"))
def engine_search_filtered(spark, sf_dir) -> DataFrame:
    source = kb(spark, sf_dir)
    env = Engine(spark, Catalog(source)).execute(Search(source=source.ref, query="heat tion stupid", limit=20, filters={"lang": "en"}))
    return env.bindings().select("document_id", "score")


@query(_search_sql("the of", "documents", "doc_id::VARCHAR", "text", "lang = 'en'", 30))
def engine_search_missing_key(spark, sf_dir) -> DataFrame:
    """A null filter value matches documents that lack the key: the English ones here."""
    docs = documents(spark, sf_dir).withColumn("metadata", F.when(F.col("metadata")["lang"] == "en", F.create_map().cast("map<string,string>")).otherwise(F.col("metadata")))
    source = DocumentSource("kb", docs, "v1")
    return Engine(spark, Catalog(source)).execute(Search(source=source.ref, query="the of", limit=30, filters={"lang": None})).bindings().select("document_id", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def engine_query(spark, sf_dir) -> DataFrame:
    wh = tables(spark, sf_dir, "orders")
    q = Query(source=wh.ref, statement="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = :st", language="sqlite", parameters={"low": 150000, "st": "O"})
    return Engine(spark, Catalog(wh)).execute(q).relation.rows.select("o_orderkey", "o_totalprice")


@query(
    f"WITH {MEMORIES} SELECT memory_id, scope_id FROM (SELECT memory_id, scope_id, {_CLICK} AS score FROM m WHERE rf <= TIMESTAMP '2024-01-10' AND (rt IS NULL OR TIMESTAMP '2024-01-10' < rt) AND vf <= TIMESTAMP '2024-01-10' AND scope_id IN ('1', '2', '3', '4', '5')) WHERE score > 0 ORDER BY score DESC, memory_id LIMIT 12"
)
def engine_recall(spark, sf_dir) -> DataFrame:
    source, scopes = memory(spark, sf_dir), tuple(ScopeRef("principal", str(i)) for i in range(1, 6))
    op = Recall(source=source.ref, query="click of user zzz", scopes=scopes, valid_at=AT, known_at=AT, limit=12)
    return Engine(spark, Catalog(source)).execute(op, Context(readable_scopes=frozenset(scopes))).bindings().select("memory_id", "scope_id")


def _changed(spark, sf_dir, *changes: Change) -> DataFrame:
    """The memory after a proposal was made and applied."""
    source, scope = memory(spark, sf_dir), ScopeRef("principal", "1")
    engine = Engine(spark, Catalog(source))
    context = Context(readable_scopes=frozenset({scope}), writable_scopes=frozenset({scope}), origin=MemoryOrigin("user_explicit", "t"))
    proposal = engine.execute(ProposeMutation(source=source.ref, draft=Draft(scope, changes, "k")), context).value
    engine.apply(proposal, replace(context, trace_id="apply"))
    m = source.versions[source.latest().version]
    return m.select("content", F.col("scope.scope_id").alias("scope_id"), F.col("recorded_to").isNull().alias("is_open"))


@query(f"WITH {MEMORIES} SELECT content, scope_id, rt IS NULL AS is_open FROM m UNION ALL SELECT 'likes tea', '1', true")
def engine_mutation_assert(spark, sf_dir) -> DataFrame:
    return _changed(spark, sf_dir, Change("assert", kind="fact", content="likes tea"))


_LAST = "(SELECT min(memory_id) FROM m WHERE scope_id = '1' AND rt IS NULL)"


def _target(spark, sf_dir) -> str:
    return memories(spark, sf_dir).where("scope.scope_id = '1' AND recorded_to IS NULL").agg(F.min("memory_id")).first()[0]


@query(f"WITH {MEMORIES} SELECT content, scope_id, rt IS NULL AND memory_id <> {_LAST} AS is_open FROM m UNION ALL SELECT 'changed', '1', true")
def engine_mutation_supersede(spark, sf_dir) -> DataFrame:
    return _changed(spark, sf_dir, Change("supersede", _target(spark, sf_dir), content="changed"))


@query(f"WITH {MEMORIES} SELECT content, scope_id, rt IS NULL AND memory_id <> {_LAST} AS is_open FROM m")
def engine_mutation_retract(spark, sf_dir) -> DataFrame:
    return _changed(spark, sf_dir, Change("retract", _target(spark, sf_dir)))


@query(pairs("('risk-label', '1.0.0')", "name, version"))
def engine_resolve_skill(spark, sf_dir) -> DataFrame:
    s = skills(spark)
    return Engine(spark, Catalog(s)).execute(ResolveSkill(source=s.ref, query="risk-label")).bindings().select("name", "version")


@query("SELECT upper(r_name) AS label FROM region WHERE r_regionkey = 2")
def engine_invoke_skill(spark, sf_dir) -> DataFrame:
    """A query's one value is a skill's argument."""
    s, wh = skills(spark), tables(spark, sf_dir, "region")
    skill = s.skills["risk-label", "1.0.0"][0].ref
    plan = Plan((Query(op_id="q", source=wh.ref, statement="SELECT r_name AS risk FROM region WHERE r_regionkey = 2"), InvokeSkill(op_id="i", source=s.ref, skill=skill, argument_bindings=(("risk", Binding(Ref("q"), "risk")),))), Ref("i"))
    return Engine(spark, Catalog(s, wh)).execute(plan).bindings().select(col("output.label").alias("label"))


@query(_walk("SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000", 2))
def engine_binding_collect(spark, sf_dir) -> DataFrame:
    """All values of a query's column start a traversal; they stay distributed."""
    g, wh = graph(spark, sf_dir), tables(spark, sf_dir, "customer")
    plan = Plan(
        (
            Query(op_id="q", source=wh.ref, statement="SELECT concat('c', c_custkey) AS id FROM customer WHERE c_acctbal > 9000"),
            Traverse(op_id="t", source=g.ref, start_binding=Binding(Ref("q"), "id", "collect", (1 << 31) - 2), max_hops=2, limit=None),
        ),
        Ref("t"),
    )
    return _told(Engine(spark, Catalog(g, wh)).execute(plan).relation.rows)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name >= 'I'")
def engine_dataflow(spark, sf_dir) -> DataFrame:
    """Project, Filter and Join of two queries as one plan."""
    wh = tables(spark, sf_dir, "nation", "region")
    plan = Plan(
        (
            Query(op_id="n", source=wh.ref, statement="SELECT * FROM nation"), Query(op_id="r", source=wh.ref, statement="SELECT * FROM region"), Project(op_id="pr", inputs=(Ref("r"),), fields=("r_regionkey", "r_name")),
            Project(op_id="pn", inputs=(Ref("n"),), fields=("n_name", "n_regionkey")), Filter(op_id="f", inputs=(Ref("pn"),), field="n_name", operator="ge", value="I"),
            Join(op_id="j", inputs=(Ref("f"), Ref("pr")), left_on=("n_regionkey",), right_on=("r_regionkey",)),
        ),
        Ref("j"),
    )
    return Engine(spark, Catalog(wh)).execute(plan).relation.rows.select(col("left.n_name").alias("n_name"), col("right.r_name").alias("r_name"))


@query(
    f"WITH a AS ({_search_sql('the and', 'documents', 'doc_id::VARCHAR', 'text', 'true', 25)}), b AS ({_search_sql('of the', 'documents', 'doc_id::VARCHAR', 'text', 'true', 25)})"
    " SELECT 'document://kb/' || document_id AS locator, n FROM (SELECT document_id, count(*) AS n FROM (SELECT document_id FROM a UNION ALL SELECT document_id FROM b) GROUP BY document_id)"
)
def engine_compose(spark, sf_dir) -> DataFrame:
    """Evidence of two searches is united; what both found stands twice, as each read it for itself."""
    source = kb(spark, sf_dir)
    plan = Plan((Search(op_id="a", source=source.ref, query="the and", limit=25), Search(op_id="b", source=source.ref, query="of the", limit=25), Compose(op_id="c", inputs=(Ref("a"), Ref("b")))), Ref("c"))
    return Engine(spark, Catalog(source)).execute(plan).evidence.groupBy("locator").agg(F.count("*").alias("n"))


@query("SELECT 'v1' AS version, n_name FROM nation")
def engine_compose_paths(spark, sf_dir) -> DataFrame:
    """Paths select a descriptor's version and a table's column."""
    source, wh = kb(spark, sf_dir), tables(spark, sf_dir, "nation")
    plan = Plan((Describe(op_id="d", source=source.ref), Query(op_id="q", source=wh.ref, statement="SELECT * FROM nation"), Compose(op_id="c", inputs=(Ref("d", ("version",)), Ref("q", ("n_name",))))), Ref("c"))
    version, names = Engine(spark, Catalog(source, wh)).execute(plan).value
    return names.select(F.lit(version).alias("version"), "n_name")


@query(CHANGED)
def engine_sync(spark, sf_dir) -> DataFrame:
    """A change set through the engine; sent again it changes nothing."""
    source = kb(spark, sf_dir)
    base, ident = source.versions["v1"][0], F.col("document_id").cast("long")
    gone = base.where(ident % 10 == 1).select(F.lit("delete").alias("kind"), "document_id", F.lit(None).cast("string").alias("content"), "metadata")
    new = base.where(ident % 10 == 2).select(F.lit("update").alias("kind"), "document_id", F.concat(F.lit("new "), F.col("metadata")["lang"]).alias("content"), "metadata")
    more = table(spark, sf_dir, "nation").select(F.lit("add").alias("kind"), F.concat(F.lit("added-"), "n_nationkey").alias("document_id"), F.col("n_name").alias("content"), F.create_map(F.lit("lang"), F.lit("en")).alias("metadata"))
    engine = Engine(spark, Catalog(source))
    changes = ChangeSet(source.ref, gone.unionByName(new).unionByName(more), "k", base_version="v1")
    engine.sync(changes)
    if not engine.sync(changes).reused:
        raise AssertionError("a change set was applied twice")
    return source.versions[source.latest().version][0].select("document_id", "content", F.col("metadata")["lang"].alias("lang"))


# --- recordings


def _two_step(wh: TableSource) -> Plan:
    return Plan((Query(op_id="q", source=wh.ref, statement="SELECT * FROM nation"), Project(op_id="p", inputs=(Ref("q"),), fields=("n_nationkey", "n_name", "n_regionkey")), Filter(op_id="f", inputs=(Ref("p"),), field="n_regionkey", operator="eq", value=1)), Ref("f"))


@query(pairs("(0, 'plan_started', ''), (1, 'operation_started', 'q'), (2, 'operation_completed', 'q'), (3, 'operation_started', 'p'), (4, 'operation_completed', 'p'), (5, 'operation_started', 'f'), (6, 'operation_completed', 'f'), (7, 'plan_completed', '')", "sequence, event, op_id"))
def engine_trace(spark, sf_dir) -> DataFrame:
    wh, log = tables(spark, sf_dir, "nation"), TraceLog()
    Engine(spark, Catalog(wh), log).execute(_two_step(wh), Context(trace_id="t"))
    return spark.createDataFrame([(e["sequence"], e["event"], e.get("op_id") or "") for e in log.get("t")], "sequence int, event string, op_id string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def engine_replay(spark, sf_dir) -> DataFrame:
    """A recorded plan runs again over its recorded results, in an engine that has never seen it."""
    wh, log, where = tables(spark, sf_dir, "nation"), TraceLog(), folder(spark)
    Engine(spark, Catalog(wh), log, ResultStore(spark, where)).execute(_two_step(wh), Context(trace_id="t"))
    return Engine(spark, Catalog(), log, ResultStore(spark, where)).replay("t").relation.rows.select("n_nationkey", "n_name")


@query(pairs("(0, 'source', 30, 3), (1, 'none', 30, 3)", "attempt, error, tokens, calls"))
def engine_resolve(spark, sf_dir) -> DataFrame:
    """Text to plan: the first draft names no known source and is repaired, its run fails with its source, another plan answers."""
    source, drafts = FlakySource(kb(spark, sf_dir), {"search": (1,)}), iter(["nowhere", "kb", "kb"])

    def send(request: str) -> tuple[str, int, Decimal]:
        return json.dumps({"operations": [{"type": "search", "op_id": "s", "source": next(drafts), "query": "the"}], "output": "s"}), 10, Decimal("0.01")

    got = Engine(spark, Catalog(source), compiler=Compiler(StructuredModel(send))).resolve("find it", Context(budget=Budget(max_tokens=30)))
    return spark.createDataFrame([(i, a.error or "none", got.usage.tokens, got.calls) for i, a in enumerate(got.attempts)], "attempt int, error string, tokens int, calls int")


@query(pairs("('o1', true, 2), ('o2', false, 1)", "outcome_id, succeeded, assertions"))
def engine_outcomes(spark, sf_dir) -> DataFrame:
    log = OutcomeLog()
    engine = Engine(spark, Catalog(), outcomes=log)
    one = Outcome("o1", "t", "task", "judge", (Assertion("a", True, Decimal("0.5")), Assertion("b", True)), AT, "k1")
    for o in (one, one, Outcome("o2", "t", "task", "judge", (Assertion("a", False),), AT + timedelta(hours=1), "k2")):
        engine.record_outcome(o)
    return spark.createDataFrame([(o.outcome_id, o.succeeded, len(o.assertions)) for o in log.list("t")], "outcome_id string, succeeded boolean, assertions int")


@query("SELECT sha256(j) AS checksum, strlen(j)::BIGINT AS size FROM (SELECT '{\"content\": \"' || n_name || '\", \"document_id\": \"n' || n_nationkey || '\", \"metadata\": {}}' AS j FROM nation)")
def artifact_store(spark, sf_dir) -> DataFrame:
    """Documents as artifacts, named by their checksum and verified where they are read."""
    store = ArtifactStore(spark, folder(spark))
    sums = [store.put_document(f"n{r['n_nationkey']}", r["n_name"]) for r in table(spark, sf_dir, "nation").collect()]
    return store.frame(sums).select("checksum", F.length("content").cast("long").alias("size"))


# --- policies

CODES = (
    "budget_exceeded", "cyclic_plan", "duplicate_op_id", "effect_exceeds_plan", "effect_exceeds_source", "incompatible_input_kind", "input_count_mismatch", "missing_input", "missing_plan_output",
    "self_reference", "source_identity_mismatch", "unknown_source", "unreachable_operation", "unsupported_input_path", "unsupported_operation",
)


@query(pairs(", ".join(f"('{c}')" for c in CODES), "code"))
def validation_codes(spark, sf_dir) -> DataFrame:
    """One broken plan for each code that validation knows."""
    source = kb(spark, sf_dir)
    catalog = Catalog(source, tables(spark, sf_dir, "nation")).descriptors()
    s = lambda i, **k: Search(op_id=i, source=k.pop("source", source.ref), query="q", **k)
    p = lambda i, r, **k: Project(op_id=i, inputs=(Ref(r, **k),), fields=("x",))
    plans = [
        ((s("a"), s("a")), "a", {}), ((s("a"),), "z", {}), ((Join(op_id="a", inputs=(Ref("b"),), left_on=("x",), right_on=("x",)), s("b")), "a", {}), ((p("a", "z"),), "a", {}), ((p("a", "a"),), "a", {}),
        ((Filter(op_id="a", inputs=(Ref("b"),), field="x", operator="eq", value=1), s("b")), "a", {}), ((p("a", "b", path=("x",)), s("b")), "a", {}), ((s("a"),), "a", {"max_effect": EffectLevel.PURE}),
        ((s("a", source=SourceRef("zz", "document")),), "a", {}), ((s("a", source=SourceRef("warehouse", "document")),), "a", {}), ((s("a"), Compose(op_id="b", inputs=(Ref("a"),))), "b", {"budget": Budget(max_actions=1)}),
        ((p("a", "b"), p("b", "a")), "a", {}), ((s("a"), s("b")), "a", {}),
    ]
    found = {i.code for ops, out, more in plans for i in validate(Plan(ops, Ref(out), **more), catalog)}
    for change in ({"capabilities": frozenset()}, {"max_effect": EffectLevel.PURE}):
        found |= {i.code for i in validate(Plan((s("a"),), Ref("a")), {"kb": replace(catalog["kb"], **change)})}
    return spark.createDataFrame([(c,) for c in sorted(found)], "code string")


@query(
    pairs(
        "('another source', 'EffectPolicyError'), ('budget of actions', 'BudgetExceeded'), ('deadline', 'DeadlineExceeded'), ('duplicate source', 'DuplicateSourceError'), ('no such version', 'SnapshotUnavailableError'), ('scope', 'ScopePolicyError'), ('unknown source', 'PlanValidationError')",
        "what, error",
    )
)
def policy_errors(spark, sf_dir) -> DataFrame:
    """What each limit of a context raises."""
    source, mem = kb(spark, sf_dir), memory(spark, sf_dir)
    engine, search = Engine(spark, Catalog(source, mem)), Search(source=source.ref, query="the")
    run = lambda op=search, **k: lambda: engine.execute(op, Context(**k))
    two = Plan((Search(op_id="a", source=source.ref, query="the"), Search(op_id="b", source=source.ref, query="of"), Fuse(op_id="f", inputs=(Ref("a"), Ref("b")))), Ref("f"))
    cases = {
        "another source": run(allowed_resources=frozenset({"warehouse"})), "budget of actions": run(two, budget=Budget(max_actions=2)), "deadline": run(deadline=AT), "duplicate source": lambda: engine.catalog.register(source),
        "no such version": run(snapshots=(replace(source.latest(), version="v0"),)), "scope": run(Recall(source=mem.ref, query="x", scopes=(ScopeRef("principal", "1"),))), "unknown source": run(Search(source=SourceRef("zz", "document"), query="x")),
    }
    return spark.createDataFrame([(k, refused(f)) for k, f in cases.items()], "what string, error string")


@query(pairs("('CREATE', 'ExecutionError'), ('DELETE', 'ExecutionError'), ('DROP', 'ExecutionError'), ('INSERT', 'ExecutionError'), ('SELECT', 'none'), ('UPDATE', 'ExecutionError'), ('two statements', 'ExecutionError')", "statement, error"))
def query_writes_refused(spark, sf_dir) -> DataFrame:
    wh = tables(spark, sf_dir, "nation")
    statements = {
        "SELECT": "SELECT * FROM nation", "CREATE": "CREATE TABLE t AS SELECT * FROM nation", "DROP": "DROP TABLE nation", "INSERT": "INSERT INTO nation SELECT * FROM nation", "DELETE": "DELETE FROM nation", "UPDATE": "UPDATE nation SET n_name = 'x'",
        "two statements": "SELECT 1; DROP TABLE nation",
    }
    return spark.createDataFrame([(k, refused(lambda s=s: wh.frame(s))) for k, s in statements.items()], "statement string, error string")
