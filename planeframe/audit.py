"""Append-only logs: execution traces, resolution traces, outcomes; and recorded results for replay."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import KernelValidationError, OutcomeConflictError, OutcomeNotFoundError, TraceConflictError, TraceError, TraceNotFoundError
from .model import digest, now
from .plans.codec import encode

_START, _ENDS = "plan_started", ("plan_completed", "plan_failed")


class TraceLog:
    """Events of runs, kept in memory and, with a path, as JSON lines that ``spark.read.json`` can query.

    A trace begins with plan_started, has contiguous numbers from 0, one end,
    and after it only events of replays. Events hold fingerprints, no content.
    """

    def __init__(self, path: str | None = None):
        self.path, self.lock = path, threading.Lock()
        self.events: dict[str, list[dict]] = {}
        for e in _read(path):
            self._check(e["trace_id"], e["event"])
            self.events.setdefault(e["trace_id"], []).append(e)

    def _check(self, trace_id: str, event: str) -> None:
        have = self.events.get(trace_id)
        if event == _START and have:
            raise TraceConflictError(f"trace {trace_id} exists")
        if event != _START and not have:
            raise TraceError("a trace begins with its plan's start")
        if have and any(x["event"] in _ENDS for x in have) and not event.startswith("replay_"):
            raise TraceError("after its end a trace has replays only")

    def add(self, trace_id: str, event: str, **data: Any) -> None:
        with self.lock:
            self._check(trace_id, event)
            e = {"trace_id": trace_id, "sequence": len(self.events.get(trace_id, ())), "event": event, "at": now().isoformat(), **encode(data)}
            self.events.setdefault(trace_id, []).append(e)
            if self.path:
                _append(self.path, e)

    def get(self, trace_id: str) -> list[dict]:
        if trace_id not in self.events:
            raise TraceNotFoundError(f"no trace {trace_id}")
        return list(self.events[trace_id])


class ResolutionLog:
    """Attempts of resolutions: numbered from 0, each ended before the next begins, none open at the end."""

    def __init__(self, path: str | None = None):
        self.path, self.lock = path, threading.Lock()
        self.events: dict[str, list[dict]] = {}
        for e in _read(path):
            self.events.setdefault(e["request_id"], []).append(e)

    def add(self, request_id: str, event: str, attempt: int | None = None, **data: Any) -> None:
        with self.lock:
            have = self.events.setdefault(request_id, [])
            opened = [e["attempt"] for e in have if e["event"] == "attempt_started"]
            ended = [e["attempt"] for e in have if e["event"] in ("attempt_completed", "attempt_failed")]
            over = any(e["event"] in ("resolution_completed", "resolution_failed") for e in have)
            ok = {
                "resolution_started": not have,
                "attempt_started": bool(have) and not over and attempt == len(opened) == len(ended),
                "attempt_completed": attempt is not None and attempt == len(opened) - 1 == len(ended),
                "attempt_failed": attempt is not None and attempt == len(opened) - 1 == len(ended),
                "resolution_completed": bool(have) and not over and len(opened) == len(ended) > 0,
                "resolution_failed": bool(have) and not over and len(opened) == len(ended),
            }.get(event, False)
            if not ok:
                raise TraceError(f"{event} can't follow here")
            e = {"request_id": request_id, "sequence": len(have), "event": event, "attempt": attempt, "at": now().isoformat(), **encode(data)}
            have.append(e)
            if self.path:
                _append(self.path, e)


def _read(path: str | None) -> list[dict]:
    """What a log holds already."""
    if not path or not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def _append(path: str, record: Mapping) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


@dataclass(frozen=True)
class Assertion:
    name: str
    passed: bool
    score: Decimal | None = None

    def __post_init__(self):
        if self.score is not None and not (isinstance(self.score, Decimal) and 0 <= self.score <= 1):
            raise KernelValidationError("a score is a decimal from 0 to 1")


@dataclass(frozen=True)
class Outcome:
    outcome_id: str
    target: str
    task: str
    evaluator: str
    assertions: tuple[Assertion, ...]
    observed_at: datetime
    idempotency_key: str
    succeeded: bool = field(default=None)  # type: ignore[assignment]

    def __post_init__(self):
        told = all(a.passed for a in self.assertions)
        if not self.assertions or self.succeeded not in (None, told):
            raise KernelValidationError("an outcome has assertions and succeeds if all of them pass")
        object.__setattr__(self, "succeeded", told)


def _outcome(v: Mapping) -> Outcome:
    """An outcome from its JSON."""
    told = tuple(Assertion(a["name"], a["passed"], None if a["score"] is None else Decimal(a["score"])) for a in v["assertions"])
    return Outcome(v["outcome_id"], v["target"], v["task"], v["evaluator"], told, datetime.fromisoformat(v["observed_at"]), v["idempotency_key"], v["succeeded"])


class OutcomeLog:
    """Outcomes; recording one again under its key changes nothing, another one under that key is refused. A log with a path knows what it held."""

    def __init__(self, path: str | None = None):
        self.path, self.lock = path, threading.Lock()
        self.records: dict[str, Outcome] = {v["idempotency_key"]: _outcome(v) for v in _read(path)}

    def record(self, outcome: Outcome) -> Outcome:
        with self.lock:
            old = self.records.get(outcome.idempotency_key)
            if old is not None:
                if old != outcome:
                    raise OutcomeConflictError(f"{outcome.idempotency_key} stands for another outcome")
                return old
            self.records[outcome.idempotency_key] = outcome
            if self.path:
                _append(self.path, encode(outcome))
            return outcome

    def get(self, outcome_id: str) -> Outcome:
        for o in self.records.values():
            if o.outcome_id == outcome_id:
                return o
        raise OutcomeNotFoundError(f"no outcome {outcome_id}")

    def list(self, target: str | None = None) -> list[Outcome]:
        return sorted((o for o in self.records.values() if target in (None, o.target)), key=lambda o: (o.observed_at, o.outcome_id))


def frame_fingerprint(df: DataFrame) -> str:
    """A fingerprint of rows that doesn't depend on their order or partitions: sums of parts of row hashes, hashed."""
    from pyspark.sql import functions as F

    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    return df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)).first()[0]


class ResultStore:
    """Results of source operations as Parquet by (trace, operation), and the plan of a trace with all its fingerprints: what a replay needs, also in another process."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.known: dict[tuple[str, str], dict] = {}

    def _path(self, trace_id: str, op_id: str, what: str) -> str:
        return f"{self.folder}/{digest(trace_id)[:16]}/{digest(op_id)[:16]}/{what}"

    def save(self, trace_id: str, op_id: str, rows: DataFrame | None, evidence: DataFrame | None) -> str:
        marks = {}
        for what, df in (("rows", rows), ("evidence", evidence)):
            if df is not None:
                df.write.mode("overwrite").parquet(self._path(trace_id, op_id, what))
                marks[what] = frame_fingerprint(self.spark.read.parquet(self._path(trace_id, op_id, what)))
        self.known[trace_id, op_id] = marks
        return digest(marks)

    def save_plan(self, trace_id: str, plan: str, marks: Mapping[str, str], final: str) -> None:
        """The plan as JSON, the fingerprint of each recorded result, and that of the whole one."""
        record = json.dumps({"plan": plan, "marks": dict(marks), "final": final, "known": {op: m for (t, op), m in self.known.items() if t == trace_id}}, sort_keys=True)
        self.spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(trace_id, "plan", "record"))

    def load_plan(self, trace_id: str) -> tuple[str, dict[str, str], str]:
        try:
            record = json.loads(self.spark.read.text(self._path(trace_id, "plan", "record"), wholetext=True).first()[0])
        except Exception:
            raise TraceNotFoundError(f"no recorded plan of {trace_id}") from None
        self.known |= {(trace_id, op): m for op, m in record["known"].items()}
        return record["plan"], record["marks"], record["final"]

    def load(self, trace_id: str, op_id: str) -> tuple[DataFrame | None, DataFrame | None, str]:
        marks = self.known.get((trace_id, op_id))
        if marks is None:
            raise TraceNotFoundError(f"no recorded result of {op_id}")
        found = {w: self.spark.read.parquet(self._path(trace_id, op_id, w)) for w in marks}
        return found.get("rows"), found.get("evidence"), digest({w: frame_fingerprint(df) for w, df in found.items()})
