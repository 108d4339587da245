"""Artifacts: immutable bytes by checksum, manifests of changes to them, and their way into a change set."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import ChangeSet
from .errors import ArtifactIntegrityError, ArtifactNotFoundError, KernelValidationError, SerializationError
from .model import SourceRef, text

MEDIA_TYPE = "application/vnd.planeframe.document+json"
KINDS = ("add", "update", "delete")


@dataclass(frozen=True)
class Artifact:
    """What a change refers to: an artifact's bytes by checksum; a deletion has none."""

    kind: str
    artifact_id: str
    checksum: str | None = None
    media_type: str = MEDIA_TYPE

    def __post_init__(self):
        text("artifact_id", self.artifact_id)
        if self.kind not in KINDS or (self.kind == "delete") != (self.checksum is None):
            raise KernelValidationError("a change adds, updates or deletes; all but a deletion have a checksum")
        if self.checksum is not None and (len(self.checksum) != 64 or set(self.checksum) - set("0123456789abcdef")):
            raise KernelValidationError("a checksum is SHA-256 in lower-case hex")


@dataclass(frozen=True)
class Manifest:
    source: SourceRef
    changes: tuple[Artifact, ...]
    idempotency_key: str
    base_version: str | None = None
    protocol: str = "1"

    def __post_init__(self):
        ids = [c.artifact_id for c in self.changes]
        if not ids or len(ids) != len(set(ids)):
            raise KernelValidationError("a manifest has changes, one for an artifact")

    def to_json(self) -> str:
        body = {"source": {"source_id": self.source.source_id, "kind": self.source.kind.value}, "changes": [c.__dict__ for c in self.changes]}
        return json.dumps({**body, "idempotency_key": self.idempotency_key, "base_version": self.base_version, "protocol": self.protocol}, sort_keys=True)

    @classmethod
    def from_json(cls, s: str) -> Manifest:
        try:
            v = json.loads(s)
            return cls(SourceRef(**v["source"]), tuple(Artifact(**c) for c in v["changes"]), v["idempotency_key"], v.get("base_version"), v.get("protocol", "1"))
        except (KeyError, TypeError, ValueError) as e:
            raise SerializationError(f"no valid manifest: {e}") from e


class ArtifactStore:
    """Files named by their checksum, in any folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, checksum: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{checksum[:2]}/{checksum}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, data: bytes) -> str:
        checksum = hashlib.sha256(data).hexdigest()
        path, fs = self._path(checksum)
        if not fs.exists(path):
            out = fs.create(path, True)
            out.write(bytearray(data))
            out.close()
        return checksum

    def put_document(self, document_id: str, content: str, metadata: Mapping[str, str] | None = None) -> str:
        return self.put(json.dumps({"document_id": document_id, "content": content, "metadata": dict(metadata or {})}, sort_keys=True, ensure_ascii=False).encode())

    def frame(self, checksums: list[str]) -> DataFrame:
        """(checksum, content binary): read by the executors, verified there."""
        lost = [c for c in checksums if not (lambda p: p[1].exists(p[0]))(self._path(c))]
        if lost:
            raise ArtifactNotFoundError(f"no artifacts {lost[:5]}")
        df = self.spark.read.format("binaryFile").load([f"{self.folder}/{c[:2]}/{c}" for c in sorted(set(checksums))])
        df = df.select(F.regexp_extract("path", "([0-9a-f]{64})$", 1).alias("checksum"), "content")
        if bad := df.where("sha2(content, 256) <> checksum").select("checksum").limit(5).collect():
            raise ArtifactIntegrityError(f"these artifacts have other bytes: {[r[0] for r in bad]}")
        return df

    def get(self, checksum: str) -> bytes:
        return bytes(self.frame([checksum]).first()["content"])


def change_set(spark: SparkSession, store: ArtifactStore, manifest: Manifest) -> ChangeSet:
    """The change set that a manifest describes; every artifact is verified and must be the document it is said to be."""
    if wrong := [c.media_type for c in manifest.changes if c.media_type != MEDIA_TYPE]:
        raise SerializationError(f"no parser for {wrong[0]}")
    told = spark.createDataFrame([(c.kind, c.artifact_id, c.checksum) for c in manifest.changes], "kind string, document_id string, _sum string")
    needed = [c.checksum for c in manifest.changes if c.checksum]
    schema = "document_id string, content string, metadata map<string,string>"
    if needed:
        docs = store.frame(needed).select("checksum", F.from_json(F.col("content").cast("string"), schema).alias("d"))
    else:
        docs = spark.createDataFrame([], f"checksum string, d struct<{schema}>")
    joined = told.join(docs, F.col("_sum") == F.col("checksum"), "left")
    if joined.where("kind <> 'delete' AND (d.document_id IS NULL OR d.document_id <> document_id)").limit(1).count():
        raise SerializationError("an artifact isn't the document that its manifest names")
    changes = joined.select("kind", "document_id", F.col("d.content").alias("content"), F.col("d.metadata").alias("metadata"))
    return ChangeSet(manifest.source, changes, manifest.idempotency_key, manifest.base_version, manifest.protocol)
