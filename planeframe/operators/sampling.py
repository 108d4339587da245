"""Samples that don't depend on how rows are partitioned, and rows from nested and crossed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(*keys: str, seed: int = 0) -> Column:
    """What decides whether a row is in a sample: a digest of its keys. A null differs from every text."""
    told = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *told))


def stratified_sample(df: DataFrame, strata: tuple[str, ...], keys: tuple[str, ...], size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` rows of each stratum: those of the smallest lots.

    The same rows on any partitioning and in any run, and samples of unions are
    samples of the samples' union. Each task cuts a stratum to ``size`` rows
    before it shuffles, so a stratum of any size is no more than ``size`` rows a
    task. Rows that agree in ``keys`` are taken in the order of their other values.
    """
    rest = [F.col(c) for c in df.columns if c not in keys and df.schema[c].dataType.typeName() != "map"]
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_lot", *rest))
    return df.withColumn("_lot", lot(*keys, seed=seed)).withColumn("_place", place).where(F.col("_place") <= size).drop("_lot", "_place")


def share_sample(df: DataFrame, keys: tuple[str, ...], share: float, seed: int = 0) -> DataFrame:
    """Rows whose lot is in the first ``share`` of all lots: about that share of the keys, with all rows of a key. No shuffle."""
    return df.where(lot(*keys, seed=seed) < F.lit(format(int(share * (1 << 64)), "016x") if share < 1 else "g"))


def pivoted(df: DataFrame, keys: tuple[str, ...], names: str, values: list, aggregates: dict[str, Column]) -> DataFrame:
    """(*keys, <value>_<aggregate>..): an aggregate of the rows of each value side by side; values are named, so that no pass looks for them."""
    wide = df.groupBy(*keys).pivot(names, values).agg(*[c.alias(n) for n, c in aggregates.items()])
    return wide if len(aggregates) > 1 else wide.withColumnsRenamed({str(v): f"{v}_{next(iter(aggregates))}" for v in values})


def melted(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], name: str = "name", value: str = "value") -> DataFrame:
    """(*keys, name, value): a row for each of the columns, nulls too."""
    kind = df.schema[columns[0]].dataType
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns])).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")
