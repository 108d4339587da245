"""Artifacts and manifests into change sets."""

import pytest

from planeframe.engine import Catalog, Engine
from planeframe.errors import ArtifactIntegrityError, ArtifactNotFoundError, KernelValidationError, SerializationError
from planeframe.lifecycle import Artifact, ArtifactStore, Manifest, change_set
from planeframe.model import Context, SnapshotRef
from planeframe.plans import Search
from planeframe.sources import DocumentSource


def test_manifest_to_source(spark, tmp_path):
    base = spark.createDataFrame([("travel", "Meals up to 100 dollars", {"d": "s"}), ("old", "Meals of old", {})], "document_id string, content string, metadata map<string,string>")
    kb = DocumentSource("kb", base, "v1")
    engine, store = Engine(spark, Catalog(kb)), ArtifactStore(spark, str(tmp_path / "store"))
    new = store.put_document("travel", "Meals up to 50 dollars", {"d": "s"})
    assert store.put_document("travel", "Meals up to 50 dollars", {"d": "s"}) == new
    m = Manifest(kb.ref, (Artifact("update", "travel", new), Artifact("delete", "old")), "k", "v1")
    assert Manifest.from_json(m.to_json()) == m
    assert engine.sync(change_set(spark, store, m)).before == "v1"
    assert engine.sync(change_set(spark, store, m)).reused
    ask = lambda ctx: [r["content"] for r in engine.execute(Search(source=kb.ref, query="meals"), ctx).value.collect()]
    assert ask(Context()) == ["Meals up to 50 dollars"]
    assert len(ask(Context(snapshots=(SnapshotRef(kb.ref, "v1"),)))) == 2
    with pytest.raises(SerializationError):
        change_set(spark, store, Manifest(kb.ref, (Artifact("add", "other", new),), "k2"))
    with pytest.raises(SerializationError):
        change_set(spark, store, Manifest(kb.ref, (Artifact("add", "x", new, "text/plain"),), "k3"))
    with pytest.raises(ArtifactNotFoundError):
        store.get("0" * 64)
    (tmp_path / "store" / new[:2] / new).write_bytes(b"tampered")
    (tmp_path / "store" / new[:2] / f".{new}.crc").unlink(missing_ok=True)
    with pytest.raises(ArtifactIntegrityError):
        store.get(new)
    for bad in ("{", "{}"):
        with pytest.raises(SerializationError):
            Manifest.from_json(bad)
    with pytest.raises(KernelValidationError):
        Manifest(kb.ref, (Artifact("delete", "a"), Artifact("delete", "a")), "k")
    with pytest.raises(KernelValidationError):
        Artifact("add", "a")
