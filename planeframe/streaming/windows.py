"""Event-time windows over streams and tables: tumbling, sliding, session; with late data."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, time_col: str, aggregates: dict[str, Column], keys: tuple[str, ...] = (), size: str | None = None, slide: str | None = None, gap: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(window_start, window_end, *keys, *aggregates) of windows in event time.

    ``size`` makes windows that follow each other, with ``slide`` ones that
    overlap, ``gap`` sessions that end when nothing came for so long. Over a
    stream, ``delay`` is how long the engine waits for rows that come late: a
    window is told once, when the latest time seen has passed its end by so much,
    and its state is dropped; what comes later still is counted as late (see
    ``run``). Over a table nothing is late, so both give the same windows. Rows
    without a time are in no window; a null key is a key.
    """
    if (size is None) == (gap is None) or (slide is not None and size is None):
        raise ValueError("a window has a size, and may have a slide, or it has a gap")
    at = F.col(time_col).cast("timestamp")
    window = F.session_window(time_col, gap) if gap else F.window(time_col, size, slide or size)
    named = events.withColumn(time_col, at).where(F.col(time_col).isNotNull())
    if events.isStreaming:
        named = named.withWatermark(time_col, delay)
    grouped = named.groupBy(window.alias("_window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *aggregates)


@dataclass(frozen=True)
class StreamRun:
    """What a stream has told so far: its rows, how many rows came too late, in how many batches."""

    rows: DataFrame
    late: int
    batches: int


def run(stream: DataFrame, folder: str) -> StreamRun:
    """Work through all that a stream has now, and append what it tells to a table in ``folder``.

    Called again it goes on from the checkpoint in the same folder; the table's
    log has each batch once, so what a failed run left over isn't read.
    """
    out = f"{folder.rstrip('/')}/rows"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return StreamRun(stream.sparkSession.read.schema(stream.schema).parquet(out), late, len(progress))


def as_stream(table: DataFrame, folder: str, time_col: str, pieces: int = 4) -> DataFrame:
    """A table as a stream of its pieces in time, each written after the one before, and at its end one row of a far time that closes all windows.

    That row has a time and nothing else, so it is in a window of its own, which
    stays open. Pieces are equal shares of the rows.
    """
    spark, path = table.sparkSession, f"{folder.rstrip('/')}/pieces-{uuid.uuid4().hex}"
    rows = table.withColumn(time_col, F.col(time_col).cast("timestamp")).where(F.col(time_col).isNotNull())
    cuts = rows.agg(F.percentile_approx(F.unix_micros(time_col), [k / pieces for k in range(1, pieces)], 10_000), F.max(time_col)).first()
    if cuts[1] is None:
        rows.write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    low = None
    for high in [*dict.fromkeys(cuts[0]), None]:
        inside = F.lit(True) if low is None else F.unix_micros(time_col) > low
        rows.where(inside if high is None else inside & (F.unix_micros(time_col) <= high)).write.mode("append").parquet(path)
        low = high
    last = spark.createDataFrame([(1,)], "n int").select(*[(F.lit(cuts[1]) + F.expr("interval 10000 days")).alias(f.name) if f.name == time_col else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "8").parquet(path)
