"""A result's relational view and its evidence, both lazy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reserved columns of a binding frame: its order, and the evidence each row rests on.
ORDER, IDS = "_ord", "_evidence_ids"
#: Columns of an evidence frame.
EVIDENCE = "evidence_id string, kind string, content string, source_id string, locator string, version string, valid_from timestamp, valid_to timestamp, score double, metadata map<string,string>, _ord long"
EVIDENCE_NAMES = [c.split()[0] for c in EVIDENCE.split(", ")]


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


@dataclass(frozen=True)
class Relation:
    """``rows`` holds the named fields, ``_ord`` and ``_evidence_ids``; ``evidence`` is there if the result has any, ``bound`` if a limit bounds its rows."""

    fields: tuple[str, ...]
    rows: DataFrame | None
    evidence: DataFrame | None = None
    bound: int | None = None

    def public(self) -> DataFrame:
        return self.rows.orderBy(ORDER).select(*map(col, self.fields))

    def of(self, rows: DataFrame, fields) -> Relation:
        return replace(self, rows=rows, fields=tuple(fields), evidence=self.evidence and used(self.evidence, rows))


def used(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """The evidence that remaining rows refer to."""
    ids = rows.select(F.explode(IDS).alias("_id")).distinct()
    return evidence.join(ids, evidence["evidence_id"] == ids["_id"], "left_semi")


def ranked(df: DataFrame, bucket: Column, *keys: Column, name: str = "_rank") -> DataFrame:
    """Number all rows from 1 by the keys, which are unique, without a task that holds them all.

    ``bucket`` falls or rises with the keys. Rows are numbered within their
    bucket; what only one task adds up are the sizes of the buckets.
    """
    dealt = df.withColumn("_bucket", bucket)
    before = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return dealt.join(before.select("_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), "_bucket").withColumn(name, (F.col("_before") + within).cast("long")).drop("_bucket", "_before")


def with_order(df: DataFrame, *keys: Column, name: str = ORDER) -> DataFrame:
    """Number rows from 0 by the keys. Only for results that are already bounded by a limit."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)


def evidence_id(op_id: str, locator: Column, version: Column, valid_from: Column | None = None, valid_to: Column | None = None) -> Column:
    """Deterministic: the same row read by the same operation has one id, by another operation another one."""
    parts = [F.lit(op_id), locator, F.coalesce(version, F.lit(""))]
    parts += [F.coalesce(c.cast("string"), F.lit("")) for c in (valid_from, valid_to) if c is not None]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def evidence_frame(df: DataFrame, op_id: str, kind: str, source_id: str, version: str | None, locator: Column, content: Column, score: Column | None = None, valid: tuple[Column, Column] | None = None, metadata: Column | None = None) -> DataFrame:
    """Evidence rows (EVIDENCE) of ordered result rows."""
    v = F.lit(version).cast("string")
    none = F.lit(None).cast("timestamp")
    lo, hi = valid or (none, none)
    return df.select(
        evidence_id(op_id, locator, v, *(valid or ())).alias("evidence_id"), F.lit(kind).alias("kind"), content.cast("string").alias("content"), F.lit(source_id).alias("source_id"), locator.alias("locator"), v.alias("version"),
        lo.cast("timestamp").alias("valid_from"), hi.cast("timestamp").alias("valid_to"), (F.lit(None) if score is None else score).cast("double").alias("score"),
        (F.lit(None) if metadata is None else metadata).cast("map<string,string>").alias("metadata"), ORDER,
    )
