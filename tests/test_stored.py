"""Versions in a shared folder: buckets, content, races, restarts; histories."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from planeframe.engine import Catalog, ChangeSet, Engine
from planeframe.errors import IdempotencyConflictError, KernelValidationError, MemoryMutationError, MemoryVersionConflictError, SyncError, VersionConflictError
from planeframe.model import Context, MemoryOrigin, ScopeRef, SnapshotRef
from planeframe.plans import ApplyMutation, Fuse, Plan, ProposeMutation, Ref, Search
from planeframe.sources import StoredDocuments, StoredMemory, Versions
from planeframe.sources.document import SCHEMA
from planeframe.sources.history import broken
from planeframe.sources.memory import SCHEMA as MEMORY
from planeframe.sources.memory import Change, Draft
from planeframe.sources.versions import put_new

CHANGES = "kind string, " + SCHEMA


def docs(spark, n=40):
    return spark.createDataFrame([(f"d{i}", f"text {i} of all", {"k": str(i % 3)}) for i in range(n)], SCHEMA)


def change(spark, *rows):
    return spark.createDataFrame([(*r, *[None, {}][len(r) - 2 :]) for r in rows], CHANGES)


def test_files_are_created_once(spark, tmp_path):
    path = str(tmp_path / "log" / "0.json")
    assert [put_new(spark, path, x) for x in "ab"] == [True, False]
    assert (tmp_path / "log" / "0.json").read_text() == "a" and len(list((tmp_path / "log").iterdir())) == 1


def test_one_change_writes_one_bucket(spark, tmp_path):
    kb = StoredDocuments(spark, "kb", str(tmp_path), docs(spark), buckets=8, index=True)
    engine = Engine(spark, Catalog(kb))
    first = kb.store.head()
    receipt = engine.sync(ChangeSet(kb.ref, change(spark, ("update", "d7", "other text", {})), "k1", first.version))
    second = kb.store.head()
    assert receipt.before == first.version and receipt.after.version == second.version != first.version
    assert len([b for b in second.buckets if second.buckets[b] != first.buckets[b]]) == 1
    written = {p.parent.name for p in (tmp_path / "data" / second.buckets[next(b for b in second.buckets if second.buckets[b] != first.buckets[b])][0].split("/")[1]).rglob("*.parquet")}
    assert len(written) == 1
    assert kb.store.rows().count() == 40 and kb.store.rows(first).where("content = 'other text'").count() == 0
    # the same content again is the first version again, under another key
    back = engine.sync(ChangeSet(kb.ref, change(spark, ("update", "d7", "text 7 of all", {"k": "1"})), "k2"))
    assert back.after.version == first.version == kb.latest().version
    ask = lambda v: sorted(r[0] for r in engine.execute(Search(source=kb.ref, query="other"), Context(snapshots=(SnapshotRef(kb.ref, v),))).value.select("document_id").collect())
    assert (ask(first.version), ask(second.version)) == ([], ["d7"])
    assert kb._keys(kb.store.rows()) == ["k"]


def test_a_restarted_engine_knows_receipts(spark, tmp_path):
    StoredDocuments(spark, "kb", str(tmp_path), docs(spark), buckets=4)
    one, two = (Engine(spark, Catalog(StoredDocuments(spark, "kb", str(tmp_path)))) for _ in range(2))
    ref = one.catalog.sources["kb"].ref
    new = change(spark, ("add", "x", "new"), ("delete", "d1"))
    done = one.sync(ChangeSet(ref, new, "key"))
    again = two.sync(ChangeSet(ref, new, "key"))
    assert again.reused and (again.before, again.after.version) == (done.before, done.after.version)
    with pytest.raises(IdempotencyConflictError):
        two.sync(ChangeSet(ref, change(spark, ("delete", "d2")), "key"))
    with pytest.raises(VersionConflictError):
        two.sync(ChangeSet(ref, change(spark, ("delete", "d2")), "other", done.before))
    for bad in (("add", "d3", "there"), ("delete", "nowhere"), ("update", "d1", "gone")):
        with pytest.raises(SyncError):
            two.sync(ChangeSet(ref, change(spark, bad), f"bad{bad}"))
    assert {r[0] for r in two.catalog.sources["kb"].store.rows().select("document_id").collect()} == {*(f"d{i}" for i in range(40) if i != 1), "x"}
    with pytest.raises(KernelValidationError):
        StoredDocuments(spark, "kb", str(tmp_path / "none"))


def test_of_two_engines_one_wins_and_the_other_goes_on(spark, tmp_path, monkeypatch):
    """The second engine commits while the first one has written its rows but not its commit."""
    schema = "id string, n int"
    a = Versions.create(spark.createDataFrame([(str(i), 0) for i in range(20)], schema), str(tmp_path), "id", 4)
    b = Versions(spark, str(tmp_path), a.schema, "id")
    ids = spark.createDataFrame([("5",)], "id string")
    up = lambda rows, head: rows.withColumn("n", F.when(F.col("id") == "5", F.col("n") + 1).otherwise(F.col("n")))
    calls = []

    def slow(rows, head):
        calls.append(head.number)
        if len(calls) == 1:
            b.commit(ids, up, "b", "m")
        return up(rows, head)

    done, reused = a.commit(ids, slow, "a", "m")
    assert (calls, done.number, reused) == ([0, 1], 2, False)
    assert a.rows().where("id = '5'").first()["n"] == 2 and a.rows().count() == 20
    assert [c.key for c in b.log()] == [None, "b", "a"]
    # with a base the one that comes late is refused, and a change that the other made is known by its key
    with pytest.raises(VersionConflictError):
        b.commit(ids, up, "c", "m", base=a.commits[1].version)
    assert b.commit(ids, up, "a", "m") == (done, True)
    assert b.count == 4 and Versions.create(a.rows(), str(tmp_path), "id", 99).count == 4


DAY = lambda n: datetime(2026, 1, n, tzinfo=UTC)


def memory_rows(*rows):
    base = {"kind": "fact", "scope": ("principal", "a"), "content": "text", "recorded_from": DAY(1), "recorded_to": None, "valid_from": None, "valid_to": None, "origin": ("user_explicit", "t"), "mutation_id": None, "evidence": [], "links": [], "metadata": {}}
    return [tuple({**base, **r, "memory_id": i}[c] for c in ("memory_id", *list(base))) for i, r in rows]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", {"recorded_to": DAY(3)}), ("b", {"recorded_from": DAY(3), "links": [("supersedes", "a")]}), ("c", {"links": [("contradicts", "b")]})], set()),
        ([("a", {}), ("a", {"content": "again"})], {("repeated", "a", None)}),
        ([("a", {"recorded_to": DAY(1)}), ("b", {"valid_from": DAY(5), "valid_to": DAY(2)})], {("empty", "a", None), ("empty", "b", None)}),
        ([("a", {"recorded_from": DAY(25)}), ("b", {"recorded_to": DAY(22)})], {("future", "a", None), ("future", "b", None)}),
        ([("a", {"links": [("contradicts", "z")]})], {("missing", "a", "z")}),
        ([("a", {"links": [("contradicts", "b")]}), ("b", {"scope": ("principal", "other")})], {("scope", "a", "b")}),
        ([("a", {"recorded_to": DAY(3), "kind": "preference"}), ("b", {"recorded_from": DAY(3), "links": [("supersedes", "a")]})], {("kind", "b", "a")}),
        ([("a", {"recorded_to": DAY(2)}), ("b", {"recorded_from": DAY(3), "links": [("supersedes", "a")]})], {("gap", "b", "a")}),
        ([("a", {"recorded_to": None}), ("b", {"recorded_from": DAY(3), "links": [("supersedes", "a")]})], {("overlap", "b", "a")}),
        ([("a", {"recorded_to": DAY(3)}), ("b", {"recorded_from": DAY(3), "links": [("supersedes", "a")]}), ("c", {"recorded_from": DAY(3), "links": [("supersedes", "a")]})], {("fork", "c", "a")}),
        ([("a", {"recorded_to": DAY(3)}), ("b", {"recorded_from": DAY(3), "recorded_to": DAY(5), "links": [("supersedes", "a")]}), ("c", {"recorded_from": DAY(5), "links": [("supersedes", "b")]})], set()),
        ([], set()),
    ],
)
def test_broken_histories(spark, rows, want):
    frame = spark.createDataFrame(memory_rows(*rows), MEMORY)
    assert {tuple(r) for r in broken(frame, DAY(20)).collect()} == want


def test_memory_in_a_folder(spark, tmp_path):
    scope = ScopeRef("principal", "a")
    frame = spark.createDataFrame(memory_rows(*[(f"m{i}", {"content": f"likes {i}", "recorded_from": DAY(1 + i % 3)}) for i in range(20)]), MEMORY)
    clock = iter(DAY(5) + timedelta(hours=i) for i in range(20))
    open_ = lambda: StoredMemory("m", frame, str(tmp_path), buckets=4, observed_at=DAY(4), clock=lambda: next(clock))
    one, two = open_(), open_()
    context = Context(readable_scopes=frozenset({scope}), writable_scopes=frozenset({scope}), origin=MemoryOrigin("user_explicit", "t"))
    engine, other = Engine(spark, Catalog(one)), Engine(spark, Catalog(two))
    propose = lambda e, m, key, target: e.execute(ProposeMutation(source=m.ref, draft=Draft(scope, (Change("supersede", target, content="now"),), key)), context).value
    mine, late = propose(engine, one, "k1", "m3"), propose(other, two, "k2", "m4")
    before = one.store.head()
    receipt = engine.apply(mine, context).value
    assert not receipt.reused and one.latest().version == two.latest().version == receipt.version.version
    assert len([b for b, x in one.store.head().buckets.items() if before.buckets.get(b) != x]) <= 2
    with pytest.raises(MemoryVersionConflictError):
        other.apply(late, context)
    # a restarted engine answers for what was applied
    again = Engine(spark, Catalog(open_())).execute(ApplyMutation(source=one.ref, proposal=mine), Context(readable_scopes=frozenset({scope}), writable_scopes=frozenset({scope}), max_effect=receipt and engine.catalog.sources["m"].descriptor.max_effect)).value
    assert again.reused and again.memory_ids == receipt.memory_ids
    assert {tuple(r) for r in broken(one.records(one.latest().version), DAY(9)).collect()} == set()
    assert one.records(one.latest().version).where("memory_id = 'm3'").first()["recorded_to"] is not None
    with pytest.raises(KernelValidationError):
        StoredMemory("m", frame.unionByName(frame.limit(1)), str(tmp_path / "broken"), observed_at=DAY(4))
    with pytest.raises(MemoryMutationError):
        engine.apply(propose(engine, one, "k9", "m3"), context)


def test_searches_of_a_plan_share_a_scan(spark, tmp_path, monkeypatch):
    kb = StoredDocuments(spark, "kb", str(tmp_path), docs(spark), buckets=2)
    asked = []
    real = kb.hits
    monkeypatch.setattr(kb, "hits", lambda v, a: asked.append(a) or real(v, a))
    plan = Plan((Search(op_id="a", source=kb.ref, query="text 3", limit=4), Search(op_id="b", source=kb.ref, query="all 5", limit=6, filters={"k": "2"}), Fuse(op_id="f", inputs=(Ref("a"), Ref("b")), limit=5)), Ref("f"))
    out = Engine(spark, Catalog(kb)).execute(plan).evidence
    assert asked == [[("text 3", 4, {}), ("all 5", 6, {"k": "2"})]] or [[x[:2] for x in a] for a in asked] == [[("text 3", 4), ("all 5", 6)]]
    assert out.count() == 5 and "FileScan" not in out._jdf.queryExecution().toString()
