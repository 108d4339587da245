"""Approximate aggregates as tables of sketches that can be kept, merged and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count's sketch, and the standard error that gives: 1.04 / sqrt(2 ** HLL_BITS).
HLL_BITS = 12
#: Size of a quantile sketch, and the error of ranks that it stays within (99 % of the time, for one rank).
KLL_SIZE, KLL_ERROR = 400, 0.0073


def hll_error(bits: int = HLL_BITS) -> float:
    return 1.04 / 2 ** (bits / 2)


def sketches(df: DataFrame, keys: tuple[str, ...], distinct: tuple[str, ...] = (), quantiles: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, n, distinct_<c>, quantiles_<c>): a row of sketches for each group; nulls and NaN are left out of sketches, n counts all rows.

    Tasks build sketches of their rows and only these are shuffled: a few KB for
    a group however many rows it has.
    """
    number = lambda c: F.col(c).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(F.coalesce(F.col(c).cast("string")), HLL_BITS).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(F.when(~F.isnan(number(c)), number(c)), KLL_SIZE).alias(f"quantiles_{c}") for c in quantiles],
    )


def merged(tables: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of the unions of groups that agree in ``keys``: coarser keys, several tables united, or both."""
    aggregates = [F.sum("n").alias("n")]
    for c in tables.columns:
        if c.startswith("distinct_"):
            aggregates.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("quantiles_"):
            aggregates.append(F.kll_merge_agg_double(c).alias(c))
    return tables.groupBy(*keys).agg(*aggregates)


def estimates(tables: DataFrame, keys: tuple[str, ...] = (), at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(*keys, n, distinct_<c> long, quantiles_<c> array<double>): what the sketches of each row say."""
    out = []
    for c in tables.columns:
        if c.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(c))
        elif c.startswith("quantiles_"):
            out.append(F.when(F.kll_sketch_get_n_double(c) > 0, F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(q))) for q in at])).alias(c))
    return tables.select(*keys, "n", *out)
