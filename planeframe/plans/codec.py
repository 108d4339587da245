"""Plans as JSON: every field of an operation under its name, typed values by their annotations."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from datetime import datetime
from decimal import Decimal
from enum import Enum
from typing import Any

from ..errors import KernelError, SerializationError
from ..model import Budget, EffectLevel, MemoryOrigin, ScopeRef, SnapshotRef, SourceKind, SourceRef
from .operations import OPERATIONS, Binding, Plan, Ref

SCHEMA, VERSION = "planeframe.plan", "1"
#: How fields that aren't plain JSON are read back.
_READ = {
    "source": lambda v: SourceRef(v["source_id"], v["kind"]),
    "kinds": tuple, "starts": tuple, "relations": tuple, "fields": tuple, "left_on": tuple, "right_on": tuple,
    "inputs": lambda v: tuple(_ref(r) for r in v),
    "start_binding": lambda v: v and _binding(v),
    "argument_bindings": lambda v: tuple((n, _binding(b)) for n, b in v),
    "scopes": lambda v: tuple(ScopeRef(**s) for s in v),
    "valid_at": lambda v: v and datetime.fromisoformat(v),
    "known_at": lambda v: v and datetime.fromisoformat(v),
    "governed_effect": lambda v: EffectLevel[v],
}


def encode(value: Any) -> Any:
    """A value of the data model as JSON."""
    if isinstance(value, EffectLevel):
        return value.name
    if isinstance(value, Enum):
        return value.value
    if dataclasses.is_dataclass(value):
        return {f.name: encode(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        return {k: encode(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [encode(v) for v in value]
    if isinstance(value, set | frozenset):
        return sorted(map(encode, value), key=str)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    return value


def _ref(v: Mapping) -> Ref:
    return Ref(v["op_id"], tuple(v.get("path", ())))


def _binding(v: Mapping) -> Binding:
    return Binding(_ref(v["ref"]), v["field"], v.get("cardinality", "single"), v.get("max_items", 100))


def _skill(v: Mapping):
    from ..sources.skill import SkillRef

    return SkillRef(**v)


def _draft(v: Mapping):
    from ..sources.memory import Change, Draft

    when = lambda x: x and datetime.fromisoformat(x)
    changes = tuple(Change(**{**c, "valid_from": when(c.get("valid_from")), "valid_to": when(c.get("valid_to")), "links": tuple(tuple(x) for x in c.get("links", ())), "evidence": tuple(c.get("evidence", ()))}) for c in v["changes"])
    return Draft(ScopeRef(**v["scope"]), changes, v["idempotency_key"])


def _proposal(v: Mapping):
    from ..sources.memory import Proposal

    b = v["base"]
    base = SnapshotRef(SourceRef(**b["source"]), b["version"], b.get("checksum"), b.get("observed_at") and datetime.fromisoformat(b["observed_at"]))
    return Proposal(v["proposal_id"], _draft(v["draft"]), base, MemoryOrigin(**v["origin"]), v["requires_approval"])


_READ |= {"skill": _skill, "draft": _draft, "proposal": _proposal}


def operation_from_dict(v: Mapping) -> Any:
    v = dict(v)
    cls = OPERATIONS.get(v.pop("type", None))
    if cls is None:
        raise SerializationError("no such operation")
    names = {f.name for f in dataclasses.fields(cls)}
    if unknown := sorted(set(v) - names):
        raise SerializationError(f"{cls.name} has no {unknown}")
    args = {k: _READ.get(k, lambda x: x)(x) for k, x in v.items()}
    if cls.name == "discover":
        args["kinds"] = tuple(map(SourceKind, args.get("kinds", ())))
    return cls(**args)


def operation_to_dict(op: Any) -> dict:
    return {"type": op.name, **encode(op)}


def plan_to_dict(plan: Plan) -> dict:
    body = encode(plan)
    return {"schema": SCHEMA, "version": VERSION, **body, "operations": [operation_to_dict(o) for o in plan.operations]}


def plan_from_dict(v: Mapping) -> Plan:
    try:
        if (v["schema"], v["version"]) != (SCHEMA, VERSION):
            raise SerializationError("another schema or version")
        b = dict(v["budget"])
        if b.get("max_cost_usd") is not None:
            b["max_cost_usd"] = Decimal(b["max_cost_usd"])
        return Plan(tuple(map(operation_from_dict, v["operations"])), _ref(v["output"]), EffectLevel[v["max_effect"]], Budget(**b), v["plan_id"])
    except SerializationError:
        raise
    except (KernelError, KeyError, TypeError, ValueError, AttributeError) as e:
        raise SerializationError(f"no valid plan: {e!r}") from e


def plan_to_json(plan: Plan) -> str:
    return json.dumps(plan_to_dict(plan), sort_keys=True, ensure_ascii=False)


def plan_from_json(s: str) -> Plan:
    try:
        v = json.loads(s)
    except ValueError as e:
        raise SerializationError(str(e)) from e
    return plan_from_dict(v)
