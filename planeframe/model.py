"""Values that plans, sources and the engine share. All of them live on the driver and are small."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime
from decimal import Decimal
from enum import Enum, IntEnum
from typing import Any

from .errors import BudgetExceeded, EffectPolicyError, KernelValidationError, ScopePolicyError


class SourceKind(str, Enum):
    DOCUMENT, TABLE, GRAPH, MEMORY, SKILL = "document", "table", "graph", "memory", "skill"


class ResultKind(str, Enum):
    SOURCE_LIST = "source_list"
    SOURCE_DESCRIPTOR = "source_descriptor"
    DOCUMENT_HITS = "document_hits"
    TABLE = "table"
    GRAPH_PATHS = "graph_paths"
    MEMORY_RECORDS = "memory_records"
    SKILL_SPECS = "skill_specs"
    SKILL_RESULT = "skill_result"
    MUTATION_PROPOSAL = "memory_mutation_proposal"
    MUTATION_RECEIPT = "memory_mutation_receipt"
    BINDING_SET = "binding_set"
    EVIDENCE_SET = "evidence_set"


class EffectLevel(IntEnum):
    PURE, READ, INTERNAL_WRITE, EXTERNAL_WRITE, DESTRUCTIVE = 0, 10, 20, 30, 40


def frozen(value: Any) -> Any:
    """A JSON value with string keys and tuples for arrays; anything else is refused."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise KernelValidationError("JSON objects have string keys")
        return {k: frozen(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return tuple(map(frozen, value))
    raise KernelValidationError(f"{type(value).__name__} is no JSON value")


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_plain)


def _plain(value: Any) -> Any:
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if hasattr(value, "__dataclass_fields__"):
        return {f.name: getattr(value, f.name) for f in fields(value)}
    raise TypeError(type(value).__name__)


def digest(*parts: Any) -> str:
    return hashlib.sha256(canonical(parts if len(parts) > 1 else parts[0]).encode()).hexdigest()


def text(name: str, value: Any) -> str:
    if not isinstance(value, str) or not value.strip():
        raise KernelValidationError(f"{name} must be a non-blank string")
    return value


def moment(name: str, value: datetime | None) -> datetime | None:
    """A time with a zone, or none."""
    if value is not None and (not isinstance(value, datetime) or value.tzinfo is None):
        raise KernelValidationError(f"{name} must have a time zone")
    return value


@dataclass(frozen=True)
class SourceRef:
    source_id: str
    kind: SourceKind

    def __post_init__(self):
        text("source_id", self.source_id)
        object.__setattr__(self, "kind", SourceKind(self.kind))


@dataclass(frozen=True)
class SnapshotRef:
    """A version of a source; when it was looked at is no part of its identity."""

    source: SourceRef
    version: str
    checksum: str | None = None
    observed_at: datetime | None = field(default=None, compare=False)

    def same_version_as(self, other: SnapshotRef) -> bool:
        sums = {self.checksum, other.checksum} - {None}
        return (self.source, self.version) == (other.source, other.version) and len(sums) < 2


@dataclass(frozen=True)
class SourceDescriptor:
    ref: SourceRef
    capabilities: frozenset[str]
    max_effect: EffectLevel = EffectLevel.READ
    version: str | None = None
    schema: Mapping[str, Any] = field(default_factory=dict)
    metadata: Mapping[str, Any] = field(default_factory=dict)


SCOPE_KINDS = ("session", "principal", "workspace", "organization")
CHANNELS = ("user_explicit", "agent_inference", "tool_observation", "system", "imported")
MEMORY_KINDS = ("fact", "preference", "decision", "experience", "procedure", "summary")
LINK_KINDS = ("supersedes", "supports", "contradicts", "derived_from")


@dataclass(frozen=True, order=True)
class ScopeRef:
    kind: str
    scope_id: str

    def __post_init__(self):
        if self.kind not in SCOPE_KINDS:
            raise KernelValidationError(f"no scope kind {self.kind}")
        text("scope_id", self.scope_id)


@dataclass(frozen=True)
class MemoryOrigin:
    channel: str
    trace_id: str | None = None

    def __post_init__(self):
        if self.channel not in CHANNELS:
            raise KernelValidationError(f"no channel {self.channel}")
        if self.channel != "imported" and not self.trace_id:
            raise KernelValidationError("an origin that isn't imported names its trace")


@dataclass(frozen=True)
class Usage:
    tokens: int = 0
    latency_ms: int = 0
    cost_usd: Decimal = Decimal(0)
    actions: int = 0

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or v < 0 or (isinstance(v, Decimal) and not v.is_finite()):
                raise KernelValidationError(f"{f.name} must be finite and not negative")

    def __add__(self, other: Usage) -> Usage:
        return Usage(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))


@dataclass(frozen=True)
class Budget:
    """Limits, none where unset; only usage above a limit breaks it."""

    max_tokens: int | None = None
    max_latency_ms: int | None = None
    max_cost_usd: Decimal | None = None
    max_actions: int | None = None

    def _pairs(self, usage: Usage):
        for f in fields(usage):
            yield f.name, getattr(self, f"max_{f.name}"), getattr(usage, f.name)

    def violations(self, usage: Usage) -> tuple[str, ...]:
        return tuple(f"{n} {used} above {most}" for n, most, used in self._pairs(usage) if most is not None and used > most)

    def require(self, usage: Usage) -> None:
        if found := self.violations(usage):
            raise BudgetExceeded("; ".join(found))

    def remaining(self, usage: Usage) -> Budget:
        return Budget(*(None if most is None else max(most - used, type(most)(0)) for _, most, used in self._pairs(usage)))


@dataclass(frozen=True)
class EffectSpec:
    level: EffectLevel = EffectLevel.READ
    resource: str | None = None
    reversible: bool = True
    requires_approval: bool = False
    approval_key: str | None = None
    idempotency_key: str | None = None

    def __post_init__(self):
        if self.level >= EffectLevel.DESTRUCTIVE and not self.requires_approval:
            raise KernelValidationError("a destructive effect requires approval")
        if self.requires_approval and not self.approval_key:
            raise KernelValidationError("an approval needs a key")

    def violations(self, context: Context) -> tuple[str, ...]:
        found = []
        if self.level > context.max_effect:
            found.append(f"effect {self.level.name} above {context.max_effect.name}")
        if context.allowed_resources and self.resource is not None and self.resource not in context.allowed_resources:
            found.append(f"resource {self.resource} isn't allowed")
        if self.level >= EffectLevel.EXTERNAL_WRITE and not self.idempotency_key:
            found.append("an external write needs an idempotency key")
        if self.requires_approval and self.approval_key not in context.approvals:
            found.append(f"approval {self.approval_key} is missing")
        return tuple(found)


@dataclass(frozen=True)
class Context:
    """Under which identity, limits and versions a plan runs."""

    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    budget: Budget = field(default_factory=Budget)
    max_effect: EffectLevel = EffectLevel.READ
    allowed_resources: frozenset[str] = frozenset()
    approvals: frozenset[str] = frozenset()
    readable_scopes: frozenset[ScopeRef] = frozenset()
    writable_scopes: frozenset[ScopeRef] = frozenset()
    origin: MemoryOrigin | None = None
    snapshots: tuple[SnapshotRef, ...] = ()
    deadline: datetime | None = None
    permissions: frozenset[str] = frozenset()

    def __post_init__(self):
        moment("deadline", self.deadline)
        ids = [s.source.source_id for s in self.snapshots]
        if len(ids) != len(set(ids)):
            raise KernelValidationError("a source has one pinned version at most")

    def pin(self, source: SourceRef) -> SnapshotRef | None:
        for s in self.snapshots:
            if s.source.source_id == source.source_id:
                if s.source.kind != source.kind:
                    raise KernelValidationError(f"{source.source_id} is pinned as another kind")
                return s
        return None

    def require_scopes(self, scopes, write: bool = False) -> None:
        have = self.writable_scopes if write else self.readable_scopes
        if missing := [s for s in scopes if s not in have]:
            raise ScopePolicyError(f"not {'writable' if write else 'readable'}: {missing}")

    def require(self, effect: EffectSpec) -> None:
        if found := effect.violations(self):
            raise EffectPolicyError(found)


def now() -> datetime:
    return datetime.now(UTC)


def finite(name: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise KernelValidationError(f"{name} must be a finite number")
    return float(value)
