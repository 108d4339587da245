"""Governed functions: a registry that can be searched, and checked calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from ..errors import EffectPolicyError, ExecutionError, KernelValidationError
from ..functions.text import HYPHENATED, fold, fold_text, overlap, query_tokens
from ..model import EffectLevel, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, canonical, digest, frozen, now, text
from ..operators import Relation, evidence_frame, with_order
from ..operators.relation import IDS, ORDER, evidence_id
from .base import Source, SourceResult

FIELDS = ("name", "version", "digest", "kind", "score", "effect", "reversible", "requires_approval", "compatibility")
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple), "object": Mapping, "null": type(None)}


def check_object(value: Mapping[str, Any], schema: Mapping[str, Any], what: str) -> None:
    """The top level of a JSON schema: required, additionalProperties false, types of properties."""
    props = schema.get("properties", {})
    if missing := [k for k in schema.get("required", ()) if k not in value]:
        raise ExecutionError(f"{what} lacks {missing}")
    if schema.get("additionalProperties") is False and (extra := sorted(set(value) - set(props))):
        raise ExecutionError(f"{what} has unknown properties {extra}")
    for k, v in value.items():
        names = props.get(k, {}).get("type")
        names = [names] if isinstance(names, str) else names or []
        if names and not any(isinstance(v, _TYPES[n]) and not (isinstance(v, bool) and n in ("integer", "number")) for n in names):
            raise ExecutionError(f"{what}.{k} must be {' or '.join(names)}")


@dataclass(frozen=True)
class SkillSpec:
    name: str
    version: str
    description: str = ""
    instructions: str = ""
    kind: str = "function"
    input_schema: Mapping[str, Any] = field(default_factory=dict)
    output_schema: Mapping[str, Any] = field(default_factory=dict)
    effect: EffectLevel = EffectLevel.PURE
    reversible: bool = True
    requires_approval: bool = False
    compatibility: str = ""
    author: str = ""
    license: str = ""
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        text("name", self.name)
        text("version", self.version)
        frozen(self.input_schema)
        frozen(self.output_schema)
        if self.effect >= EffectLevel.DESTRUCTIVE and not self.requires_approval:
            raise KernelValidationError("a destructive skill requires approval")

    @property
    def digest(self) -> str:
        return digest(self)

    @property
    def ref(self) -> SkillRef:
        return SkillRef(self.name, self.version, self.digest)


@dataclass(frozen=True)
class SkillRef:
    name: str
    version: str
    digest: str


def resolve_frame(registry: DataFrame, query: str, limit: int) -> DataFrame:
    """Skills that match: 2 for the exact name, else 1 for the query as a phrase, plus the share of its words; ties by name, version, digest."""
    tokens = query_tokens(query, hyphen=True)
    said = F.concat_ws(" ", "name", "description")
    exact = F.col("name") == F.lit(query.strip())
    phrase = F.contains(fold(said), F.lit(fold_text(query.strip())))
    share = overlap(said, tokens, HYPHENATED)
    score = F.when(exact, 2.0).when(phrase, 1.0).otherwise(0.0) + share / F.lit(float(max(1, len(tokens))))
    return registry.withColumn("score", score).where(exact | phrase | (share > 0)).orderBy(F.desc("score"), "name", "version", "digest").limit(limit)


class SkillSource(Source):
    """Registered skills with handlers ``(arguments, context) -> dict``; a skill without one is for reading only.

    ``columns`` gives a skill's vectorised form: a function of columns, used by
    ``apply`` on whole frames. ``batches`` gives one that columns can't express:
    a function from an Arrow table of arguments to one of outputs, row by row.
    """

    def __init__(
        self, spark: SparkSession, source_id: str, skills: list[tuple[SkillSpec, Callable | None]], columns: Mapping[str, Callable[..., Column]] | None = None,
        batches: Mapping[str, Callable[[pa.Table], pa.Table]] | None = None,
    ):
        self.spark = spark
        self.ref = SourceRef(source_id, SourceKind.SKILL)
        self.skills = {(s.name, s.version): (s, h) for s, h in skills}
        if len(self.skills) < len(skills):
            raise KernelValidationError("a skill's name and version are unique")
        self.columns, self.batches = dict(columns or {}), dict(batches or {})
        version = "skills:" + digest(sorted(s.digest for s, _ in skills))[:16]
        top = max((s.effect for s, _ in skills), default=EffectLevel.READ)
        self.descriptor = SourceDescriptor(self.ref, frozenset({"resolve_skill", "invoke_skill"}), max(top, EffectLevel.READ), version)
        self._snapshot = SnapshotRef(self.ref, version, None, now())

    def latest(self) -> SnapshotRef:
        return self._snapshot

    def registry(self) -> DataFrame:
        rows = [(s.name, s.version, s.digest, s.kind, s.description, s.instructions, s.effect.name, s.reversible, s.requires_approval, s.compatibility) for s, _ in self.skills.values()]
        return self.spark.createDataFrame(rows, "name string, version string, digest string, kind string, description string, instructions string, effect string, reversible boolean, requires_approval boolean, compatibility string")

    def resolve_skill(self, op, context) -> SourceResult:
        snap = self.snapshot(context)
        hits = with_order(resolve_frame(self.registry(), op.query, op.limit), F.desc("score"), F.col("name"), F.col("version"), F.col("digest"))
        locator = F.concat(F.lit(f"skill://{self.ref.source_id}/"), "name", F.lit("@"), "version", F.lit("#"), "digest")
        evidence = evidence_frame(hits, op.op_id, "skill", self.ref.source_id, snap.version, locator, F.col("instructions"), F.col("score"))
        rows = hits.select(*FIELDS, ORDER, F.array(evidence_id(op.op_id, locator, F.lit(snap.version))).alias(IDS))
        return SourceResult(hits.drop(ORDER), Relation(FIELDS, rows, evidence), snap)

    def _find(self, ref: SkillRef) -> tuple[SkillSpec, Callable | None]:
        spec, handler = self.skills.get((ref.name, ref.version), (None, None))
        if spec is None or spec.digest != ref.digest:
            raise ExecutionError(f"no skill {ref.name}@{ref.version} of that digest")
        return spec, handler

    def invoke_skill(self, op, context, bound: Mapping[str, Any] | None = None) -> SourceResult:
        spec, handler = self._find(op.skill)
        if handler is None:
            raise ExecutionError(f"{spec.name} is for reading only")
        if (op.governed_effect, op.reversible, op.requires_approval) != (spec.effect, spec.reversible, spec.requires_approval):
            raise EffectPolicyError([f"{spec.name} is registered under another policy"])
        arguments = {**op.arguments, **(bound or {})}
        check_object(arguments, spec.input_schema, "the input")
        output = handler(dict(arguments), context)
        if not isinstance(output, Mapping):
            raise ExecutionError("a skill returns an object")
        check_object(output, spec.output_schema, "the output")
        names = sorted(output)
        fields = ["skill_name", "skill_version", "skill_digest", *(f"output.{n}" for n in names)]
        snap = self.snapshot(context)
        plain = [v if isinstance(v, str | bool | int | float) or v is None else canonical(v) for v in (output[n] for n in names)]
        one = self.spark.range(1).select(F.lit(spec.name).alias("skill_name"), F.lit(spec.version).alias("skill_version"), F.lit(spec.digest).alias("skill_digest"), *[F.lit(v).alias(f"output.{n}") for n, v in zip(names, plain, strict=True)], F.lit(0).cast("long").alias(ORDER))
        locator = F.lit(f"skill://{self.ref.source_id}/{spec.name}@{spec.version}#{spec.digest}/invocations/{op.op_id}")
        evidence = evidence_frame(one, op.op_id, "skill", self.ref.source_id, snap.version, locator, F.lit(json.dumps(output, sort_keys=True)))
        return SourceResult(dict(output), Relation(tuple(fields), one.withColumn(IDS, F.array(evidence_id(op.op_id, locator, F.lit(snap.version)))), evidence), snap)

    def apply(self, df: DataFrame, ref: SkillRef, output: str = "output", **arguments: Column) -> DataFrame:
        """A skill over a whole frame: its native column form, evaluated where the rows are."""
        spec, _ = self._find(ref)
        if spec.name not in self.columns:
            raise ExecutionError(f"{spec.name} has no column form")
        return df.withColumn(output, self.columns[spec.name](**arguments))

    def apply_batches(self, df: DataFrame, ref: SkillRef, output: str = "output", **arguments: Column) -> DataFrame:
        """A skill over a whole frame by its batch form: ``df`` and a struct of the outputs, of the type that the output schema says.

        Only a skill without effects runs so, since a lost task runs again. Each
        batch is checked against both schemas where it is worked on: a required
        property that is missing, or null without being allowed to, and a value
        of another type fail the job, as a call would.
        """
        spec, _ = self._find(ref)
        if spec.name not in self.batches:
            raise ExecutionError(f"{spec.name} has no batch form")
        if spec.effect > EffectLevel.READ:
            raise EffectPolicyError([f"{spec.name} has effects, so it is called once for each input"])
        if missing := [k for k in spec.input_schema.get("required", ()) if k not in arguments]:
            raise ExecutionError(f"the input lacks {missing}")
        if spec.input_schema.get("additionalProperties") is False and (extra := sorted(set(arguments) - set(spec.input_schema.get("properties", {})))):
            raise ExecutionError(f"the input has unknown properties {extra}")
        kind = struct_of(spec.output_schema)
        run, given, told = self.batches[spec.name], {k: _nullable(spec.input_schema, k) for k in arguments}, {k: _nullable(spec.output_schema, k) for k in kind.names}
        arrow = to_arrow_type(kind)
        named = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in arguments.items()])
        for k in arguments:
            want = spec.input_schema.get("properties", {}).get(k, {}).get("type")
            if isinstance(want, str) and want in _COLUMN and named.schema[k].dataType.typeName() not in _COLUMN[want]:
                raise ExecutionError(f"the input.{k} must be {want}")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                table = pa.Table.from_batches([b.select(list(given))])
                if bad := [k for k, free in given.items() if not free and table[k].null_count]:
                    raise ValueError(f"the input has nulls in {bad}")
                out = run(table)
                if out.num_rows != b.num_rows or set(out.column_names) - set(told):
                    raise ValueError("a batch of outputs has a row for each input, and no unknown properties")
                if bad := [k for k, free in told.items() if not free and (k not in out.column_names or out[k].null_count)]:
                    raise ValueError(f"the output lacks {bad}")
                cols = [out[k].combine_chunks().cast(arrow.field(k).type) if k in out.column_names else pa.nulls(b.num_rows, arrow.field(k).type) for k in told]
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.StructArray.from_arrays(cols, names=list(told))], names=["_row", output])

        schema = StructType([named.schema["_row"], StructField(output, kind)])
        return named.mapInArrow(each, schema).select("_row.*", output)


#: Types of columns that a property may be given, by its JSON type.
_COLUMN = {"string": ("string",), "integer": ("byte", "short", "integer", "long"), "number": ("byte", "short", "integer", "long", "float", "double", "decimal"), "boolean": ("boolean",)}


def _nullable(schema: Mapping[str, Any], name: str) -> bool:
    """Whether a property may be null: if its types say so, or if nothing is said of it."""
    kind = schema.get("properties", {}).get(name, {}).get("type")
    return name not in schema.get("required", ()) or isinstance(kind, list | tuple) and "null" in kind


def struct_of(schema: Mapping[str, Any]) -> StructType:
    """The type of objects of a JSON schema."""

    def kind(s: Mapping[str, Any]) -> DataType:
        names = s.get("type")
        names = [names] if isinstance(names, str) else [n for n in names or () if n != "null"]
        if len(names) != 1:
            raise KernelValidationError(f"a property needs one type, not {names}")
        if names[0] == "array":
            return ArrayType(kind(s.get("items", {})))
        if names[0] == "object":
            return struct_of(s)
        return {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}[names[0]]

    return StructType([StructField(k, kind(s)) for k, s in schema.get("properties", {}).items()])
