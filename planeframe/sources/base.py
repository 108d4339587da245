"""What a source is, and what its operations return."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SnapshotUnavailableError
from ..model import Context, SnapshotRef, SourceDescriptor, Usage, digest
from ..operators import Relation


def kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """A version as a table of its own in ``folder`` or the cluster's shared one: it outlives the batch it came
    from and carries no lineage. Where neither is there the frame stays lazy."""
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/versions/{digest(name)[:16]}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class SourceResult:
    """``value`` is the native result (a frame where there are many rows), ``relation`` its relational view and
    evidence. ``checks`` are asked once, when the result is read: each gives a warning or none."""

    value: Any
    relation: Relation
    snapshot: SnapshotRef | None = None
    usage: Usage = field(default_factory=Usage)
    checks: tuple[Callable[[], str | None], ...] = ()
    #: Checks that, when they warn, also make the result partial.
    partial: tuple[Callable[[], str | None], ...] = ()


class Source:
    """A source serves the version its context pins, or its latest one."""

    descriptor: SourceDescriptor

    def operations(self) -> dict[str, Callable[..., SourceResult]]:
        """Handlers by operation name: (operation, context) -> SourceResult."""
        return {name: getattr(self, name) for name in self.descriptor.capabilities if hasattr(self, name)}

    def snapshot(self, context: Context | None = None) -> SnapshotRef:
        """The version that is served."""
        pin = context.pin(self.descriptor.ref) if context else None
        latest = self.latest()
        if pin is None:
            return latest
        for s in self.available():
            if s.same_version_as(pin):
                return s
        raise SnapshotUnavailableError(f"{pin.source.source_id} has no version {pin.version}")

    def latest(self) -> SnapshotRef:
        raise NotImplementedError

    def available(self) -> list[SnapshotRef]:
        return [self.latest()]
