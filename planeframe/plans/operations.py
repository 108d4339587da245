"""The fifteen operations as values, and plans of them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, ClassVar

from ..errors import KernelValidationError
from ..functions.predicates import OPERATORS
from ..model import MEMORY_KINDS, Budget, EffectLevel, EffectSpec, ResultKind, ScopeRef, SourceKind, SourceRef, frozen, moment, text

BOUND = frozenset({ResultKind.DOCUMENT_HITS, ResultKind.TABLE, ResultKind.GRAPH_PATHS, ResultKind.MEMORY_RECORDS, ResultKind.SKILL_SPECS, ResultKind.SKILL_RESULT, ResultKind.BINDING_SET})
EVIDENT = BOUND | {ResultKind.EVIDENCE_SET}


@dataclass(frozen=True)
class Ref:
    """The result of another operation, or what a path (mapping keys, sequence indexes, attributes) selects in its value."""

    op_id: str
    path: tuple[str | int, ...] = ()


@dataclass(frozen=True)
class Binding:
    """Values that another operation's rows give at run time: of its one row, or the distinct ones of all rows."""

    ref: Ref
    field: str
    cardinality: str = "single"
    max_items: int = 100

    def __post_init__(self):
        text("field", self.field)
        if self.cardinality not in ("single", "collect") or self.max_items < 1:
            raise KernelValidationError("a binding is 'single' or 'collect', of one item at least")


@dataclass(frozen=True, kw_only=True)
class Operation:
    op_id: str = field(default_factory=lambda: f"op-{uuid.uuid4().hex[:12]}")

    name: ClassVar[str]
    output: ClassVar[ResultKind]
    source_kind: ClassVar[SourceKind | None] = None
    #: Kinds that inputs may have, how many there are, and whether they may select by a path.
    accepts: ClassVar[frozenset] = frozenset()
    arity: ClassVar[tuple[int, int | None]] = (0, 0)
    takes_paths: ClassVar[bool] = False
    level: ClassVar[EffectLevel] = EffectLevel.READ

    def __post_init__(self):
        text("op_id", self.op_id)
        source = getattr(self, "source", None)
        if source is not None and self.source_kind is not None and source.kind != self.source_kind:
            raise KernelValidationError(f"{self.name} reads a {self.source_kind.value} source, not a {source.kind.value}")
        self.check()

    def check(self) -> None:
        return

    @property
    def effect(self) -> EffectSpec:
        source = getattr(self, "source", None)
        return EffectSpec(self.level, source.source_id if source else None)

    @property
    def refs(self) -> tuple[Ref, ...]:
        return tuple(getattr(self, "inputs", ()))

    @property
    def bindings(self) -> tuple[Binding, ...]:
        return ()


@dataclass(frozen=True, kw_only=True)
class Discover(Operation):
    kinds: tuple[SourceKind, ...] = ()
    name, output, level = "discover", ResultKind.SOURCE_LIST, EffectLevel.PURE


@dataclass(frozen=True, kw_only=True)
class Describe(Operation):
    source: SourceRef
    name, output = "describe", ResultKind.SOURCE_DESCRIPTOR


@dataclass(frozen=True, kw_only=True)
class Search(Operation):
    source: SourceRef
    query: str
    limit: int = 10
    filters: Mapping[str, Any] = field(default_factory=dict)
    name, output, source_kind = "search", ResultKind.DOCUMENT_HITS, SourceKind.DOCUMENT

    def check(self):
        text("query", self.query)
        frozen(self.filters)
        _positive(limit=self.limit)


@dataclass(frozen=True, kw_only=True)
class Query(Operation):
    source: SourceRef
    statement: str
    language: str = "sql"
    parameters: Mapping[str, Any] = field(default_factory=dict)
    name, output, source_kind = "query", ResultKind.TABLE, SourceKind.TABLE

    def check(self):
        text("statement", self.statement)
        frozen(self.parameters)


@dataclass(frozen=True, kw_only=True)
class Traverse(Operation):
    source: SourceRef
    starts: tuple[str, ...] = ()
    start_binding: Binding | None = None
    direction: str = "out"
    relations: tuple[str, ...] = ()
    min_hops: int = 1
    max_hops: int = 2
    limit: int | None = 100
    simple_paths: bool = True
    name, output, source_kind, accepts, arity = "traverse", ResultKind.GRAPH_PATHS, SourceKind.GRAPH, BOUND, (0, 1)

    def check(self):
        if bool(self.starts) == (self.start_binding is not None):
            raise KernelValidationError("a traversal has starts or a binding for them")
        if self.direction not in ("out", "in", "both") or not 1 <= self.min_hops <= self.max_hops or not self.simple_paths:
            raise KernelValidationError("directions are out, in, both; 1 <= min_hops <= max_hops; paths are simple")
        if self.limit is not None:
            _positive(limit=self.limit)

    @property
    def refs(self):
        return (self.start_binding.ref,) if self.start_binding else ()

    @property
    def bindings(self):
        return (self.start_binding,) if self.start_binding else ()


@dataclass(frozen=True, kw_only=True)
class Recall(Operation):
    source: SourceRef
    query: str
    scopes: tuple[ScopeRef, ...]
    kinds: tuple[str, ...] = ()
    valid_at: datetime | None = None
    known_at: datetime | None = None
    limit: int = 10
    name, output, source_kind = "recall", ResultKind.MEMORY_RECORDS, SourceKind.MEMORY

    def check(self):
        text("query", self.query)
        if not self.scopes or not set(self.kinds) <= set(MEMORY_KINDS):
            raise KernelValidationError("a recall names scopes, and known kinds only")
        moment("valid_at", self.valid_at)
        moment("known_at", self.known_at)
        _positive(limit=self.limit)


@dataclass(frozen=True, kw_only=True)
class ResolveSkill(Operation):
    source: SourceRef
    query: str
    limit: int = 5
    name, output, source_kind = "resolve_skill", ResultKind.SKILL_SPECS, SourceKind.SKILL

    def check(self):
        text("query", self.query)
        _positive(limit=self.limit)


@dataclass(frozen=True, kw_only=True)
class InvokeSkill(Operation):
    source: SourceRef
    skill: Any
    governed_effect: EffectLevel = EffectLevel.PURE
    arguments: Mapping[str, Any] = field(default_factory=dict)
    argument_bindings: tuple[tuple[str, Binding], ...] = ()
    reversible: bool = True
    requires_approval: bool = False
    approval_key: str | None = None
    idempotency_key: str | None = None
    name, output, source_kind, accepts, arity = "invoke_skill", ResultKind.SKILL_RESULT, SourceKind.SKILL, BOUND, (0, None)

    def check(self):
        names = [n for n, _ in self.argument_bindings]
        if len(names) != len(set(names)) or set(names) & set(self.arguments):
            raise KernelValidationError("an argument is given once, as a value or by a binding")
        frozen(self.arguments)
        assert self.effect is not None

    @property
    def effect(self):
        return EffectSpec(self.governed_effect, self.source.source_id, self.reversible, self.requires_approval, self.approval_key, self.idempotency_key)

    @property
    def refs(self):
        return tuple(dict.fromkeys(b.ref for _, b in self.argument_bindings))

    @property
    def bindings(self):
        return tuple(b for _, b in self.argument_bindings)


@dataclass(frozen=True, kw_only=True)
class ProposeMutation(Operation):
    source: SourceRef
    draft: Any
    name, output, source_kind = "propose_mutation", ResultKind.MUTATION_PROPOSAL, SourceKind.MEMORY


@dataclass(frozen=True, kw_only=True)
class ApplyMutation(Operation):
    source: SourceRef
    proposal: Any
    name, output, source_kind, level = "apply_mutation", ResultKind.MUTATION_RECEIPT, SourceKind.MEMORY, EffectLevel.INTERNAL_WRITE

    @property
    def effect(self):
        p = self.proposal
        return EffectSpec(self.level, self.source.source_id, True, p.requires_approval, p.approval_key if p.requires_approval else None, p.draft.idempotency_key)


@dataclass(frozen=True, kw_only=True)
class Project(Operation):
    inputs: tuple[Ref, ...]
    fields: tuple[str, ...]
    name, output, accepts, arity, level = "project", ResultKind.BINDING_SET, BOUND, (1, 1), EffectLevel.PURE

    def check(self):
        if not self.fields or len(set(self.fields)) < len(self.fields):
            raise KernelValidationError("a projection has distinct fields")


@dataclass(frozen=True, kw_only=True)
class Filter(Operation):
    inputs: tuple[Ref, ...]
    field: str
    operator: str
    value: Any = None
    name, output, accepts, arity, level = "filter", ResultKind.BINDING_SET, frozenset({ResultKind.BINDING_SET}), (1, 1), EffectLevel.PURE

    def check(self):
        text("field", self.field)
        frozen(self.value)
        if self.operator not in OPERATORS:
            raise KernelValidationError(f"no operator {self.operator}")


@dataclass(frozen=True, kw_only=True)
class Join(Operation):
    inputs: tuple[Ref, ...]
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]
    left_alias: str = "left"
    right_alias: str = "right"
    name, output, accepts, arity, level = "join", ResultKind.BINDING_SET, frozenset({ResultKind.BINDING_SET}), (2, 2), EffectLevel.PURE

    def check(self):
        if not self.left_on or len(self.left_on) != len(self.right_on):
            raise KernelValidationError("a join has as many keys on either side, one at least")
        if self.left_alias == self.right_alias or "." in self.left_alias + self.right_alias or not (self.left_alias and self.right_alias):
            raise KernelValidationError("aliases are distinct and without dots")


@dataclass(frozen=True, kw_only=True)
class Fuse(Operation):
    inputs: tuple[Ref, ...]
    strategy: str = "rrf"
    limit: int = 20
    rank_constant: int = 60
    name, output, accepts, arity, level = "fuse", ResultKind.EVIDENCE_SET, EVIDENT, (1, None), EffectLevel.PURE

    def check(self):
        if self.strategy != "rrf":
            raise KernelValidationError(f"no strategy {self.strategy}")
        _positive(limit=self.limit, rank_constant=self.rank_constant)


@dataclass(frozen=True, kw_only=True)
class Compose(Operation):
    inputs: tuple[Ref, ...]
    strategy: str = "evidence_union"
    name, output, accepts, arity, takes_paths, level = "compose", ResultKind.EVIDENCE_SET, frozenset(ResultKind), (1, None), True, EffectLevel.PURE

    def check(self):
        text("strategy", self.strategy)


def _positive(**values: int) -> None:
    for k, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise KernelValidationError(f"{k} must be a positive integer")


OPERATIONS: dict[str, type[Operation]] = {c.name: c for c in (Discover, Describe, Search, Query, Traverse, Recall, ResolveSkill, InvokeSkill, ProposeMutation, ApplyMutation, Project, Filter, Join, Fuse, Compose)}
DATAFLOW = frozenset({"project", "filter", "join", "fuse", "compose"})


@dataclass(frozen=True)
class Plan:
    """Operations, the one whose result is the plan's, and what the plan may do at most."""

    operations: tuple[Operation, ...]
    output: Ref
    max_effect: EffectLevel = EffectLevel.READ
    budget: Budget = field(default_factory=Budget)
    plan_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if not self.operations:
            raise KernelValidationError("a plan has operations")
