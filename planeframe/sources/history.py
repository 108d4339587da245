"""Checks of bi-temporal histories, as rows that break a rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broken(records: DataFrame, observed_at: datetime | None = None, links_of: list[str] | None = None) -> DataFrame:
    """(rule, memory_id, other): each way in which a history contradicts itself; none if it is sound.

    - ``repeated``: an id stands twice
    - ``empty``: an interval ends where it begins or before
    - ``future``: a record begins or ends after ``observed_at``
    - ``missing``, ``scope``: a link's target isn't there, or is in another scope
    - ``kind``: a replacement is of another kind than what it supersedes
    - ``gap``, ``overlap``: what is superseded ends before, or after, its replacement begins
    - ``fork``: two replacements of one record are recorded at a time

    Links are those of all records, or of ``links_of`` only, whose targets are
    then all that must be in ``records``. Joins by id and windows over the
    replacements of one record: nothing is gathered.
    """
    none = F.lit(None).cast("string")
    told = lambda df, rule, other=none: df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "memory_id", other.alias("other"))
    out = told(records.groupBy("memory_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    out = out.unionByName(told(records.where("recorded_to <= recorded_from OR valid_to <= valid_from"), "empty"))
    if observed_at is not None:
        at = F.lit(observed_at)
        out = out.unionByName(told(records.where((F.col("recorded_from") > at) | (F.col("recorded_to") > at)), "future"))
    some = records if links_of is None else records.where(F.col("memory_id").isin(list(links_of)))
    links = some.select("memory_id", "kind", "scope", "recorded_from", "recorded_to", F.explode("links").alias("link"))
    target = records.select(F.col("memory_id").alias("_id"), F.col("kind").alias("_kind"), F.col("scope").alias("_scope"), F.col("recorded_to").alias("_to"))
    # a repeated target counts once: it has a row of its own above
    target = target.groupBy("_id").agg(F.min_by(F.struct("_kind", "_scope", "_to"), F.struct("_to", "_kind")).alias("_of"))
    met = links.join(target, F.col("link.target_id") == F.col("_id"), "left")
    replaces = F.col("link.kind") == "supersedes"
    begins, ends = F.coalesce("recorded_from", F.lit(datetime(1, 1, 1))), F.coalesce("_of._to", F.lit(datetime(9999, 12, 31)))
    rule = (
        F.when(F.col("_id").isNull(), "missing").when(F.col("_of._scope") != F.col("scope"), "scope").when(replaces & (F.col("_of._kind") != F.col("kind")), "kind")
        .when(replaces & (ends < begins), "gap").when(replaces & (ends > begins), "overlap")
    )
    out = out.unionByName(told(met.withColumn("_rule", rule).where("_rule IS NOT NULL"), F.col("_rule"), F.col("link.target_id")))
    # a sweep over the replacements of each record: does one begin before all earlier ones have ended?
    line = Window.partitionBy("link.target_id").orderBy("recorded_from", "memory_id").rowsBetween(Window.unboundedPreceding, -1)
    swept = links.where(replaces).withColumn("_open", F.max(F.coalesce("recorded_to", F.lit(datetime(9999, 12, 31)))).over(line)).where("_open > recorded_from")
    return out.unionByName(told(swept, "fork", F.col("link.target_id")))
