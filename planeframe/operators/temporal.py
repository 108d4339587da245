"""As-of joins: each left row with the nearest right row of its key in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key and stretch of time that one task is meant to hold.
STRETCH = 100_000


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], direction: str = "backward", strict: bool = False, tolerance: float | None = None, how: str = "inner",
    stretch: int = STRETCH, tie: str | None = None,
) -> DataFrame:
    """All columns of ``left`` and, of the last right row of its key at or before its time, ``columns`` (null values included).

    ``direction`` ``forward`` takes the first right row at or after instead;
    ``strict`` leaves out equal times; ``tolerance`` bounds the distance (seconds
    for timestamps). ``how`` is ``inner`` or ``left``. Rows with a null key or
    time match nothing; of right rows of one time the one with the greatest
    ``tie`` value counts (if none is named, of the greatest values in the order of
    ``columns``). Repeated left rows stay as many.

    Both sides are put in line by key and time and each row carries the last
    right row before it. A key's line is cut into stretches of time, so that one
    key's rows are many tasks: within a stretch a window carries, between
    stretches only their last right rows are gone through. Stretches are equal
    shares of the keys' rows by quantiles of time, so a burst is cut as finely as
    a long time is.
    """
    if direction not in ("backward", "forward") or how not in ("inner", "left"):
        raise ValueError("direction is backward or forward, how is inner or left")
    sign, moments = (1 if direction == "backward" else -1), ("timestamp", "timestamp_ntz", "date")
    number = lambda c, df: (F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName() in moments else F.col(c)) * sign
    keys = [f"_k{i}" for i in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    usable = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("_t", *keys)])
    a = left.select(F.struct(*left.columns).alias("_left"), *named, number(left_time, left).alias("_t"))
    b = right.select(F.struct(*columns).alias("_right"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), *named, number(right_time, right).alias("_t")).where(usable)
    lone, a = a.where(~usable), a.where(usable)
    # one right row for each key and time
    b = b.groupBy(*keys, "_t").agg(F.max(F.struct("_tie", "_right")).alias("_r")).select(*keys, "_t", F.struct(F.col("_t").alias("at"), F.col("_r._right").alias("row")).alias("_right"))
    # at equal times a right row stands before a left one, unless it must be strictly before
    line = b.select(*keys, "_t", F.lit(1 if strict else 0).alias("_side"), "_right", F.lit(None).cast(a.schema["_left"].dataType).alias("_left")).unionByName(
        a.select(*keys, "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(b.schema["_right"].dataType).alias("_right"), "_left")
    )
    sizes = line.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_t", [i / 64 for i in range(1, 64)], 1000).alias("_cuts")).where(F.col("_n") > stretch)
    # a key of n rows is cut at every (64 * stretch / n)-th of its quantiles
    every = F.greatest(F.lit(1), F.floor(F.lit(64.0 * stretch) / F.col("_n"))).cast("int")
    sizes = sizes.select(*keys, F.array_distinct(F.filter("_cuts", lambda x, i: i % every == 0)).alias("_cuts"))
    line = line.join(sizes, keys, "left").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col("_t"))), F.lit(0))).drop("_cuts")
    within = Window.partitionBy(*keys, "_part").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = line.withColumn("_found", F.last("_right", ignorenulls=True).over(within))
    ends = line.where("_right is not null").groupBy(*keys, "_part").agg(F.max_by("_right", "_t").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = line.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left").withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_part > 0 and _before is not null")
    got = carried.where("_left is not null").join(parts.select(*keys, "_part", "_before"), [*keys, "_part"], "left")
    got = got.select("_left", "_t", F.coalesce("_found", "_before").alias("_found"))
    if tolerance is not None:
        scale = 1_000_000 if left.schema[left_time].dataType.typeName() in moments else 1
        got = got.withColumn("_found", F.when(F.col("_t") - F.col("_found.at") <= tolerance * scale, F.col("_found")))
    got = got.drop("_t")
    if how == "inner":
        got = got.where("_found is not null")
    else:
        got = got.unionByName(lone.select("_left", F.lit(None).cast(got.schema["_found"].dataType).alias("_found")))
    return got.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_found.row")[c].alias(c if c not in left.columns else f"right_{c}") for c in columns])
