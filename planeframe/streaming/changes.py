"""Changes of documents as a stream with state: each change is told once, in order, whatever comes twice or late."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What ``effective_changes`` tells.
TOLD = "document_id string, sequence long, alive boolean, content string, metadata map<string,string>"


def effective_changes(changes: DataFrame, forget: str = "7 days") -> DataFrame:
    """(document_id, sequence, alive, content, metadata): of a stream of changes (kind, document_id, content, metadata, sequence) those that change a document.

    Each document's state is the number of its last change, a digest of its
    content, and whether it is alive. A change with a number that isn't beyond
    it, or with the content that is there, tells nothing; a document's first
    change always tells. A deleted document is
    forgotten ``forget`` after its deletion was worked on: until then its late
    changes are known to be late. Time counts from then, and not by a time in the
    rows, so that no change is left out because it comes late. Of several changes
    in a batch the last counts. Rows without an id or number are left out.
    """
    mark = F.sha2(F.to_json(F.struct("content", F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))).alias("m")), {"ignoreNullFields": "false"}), 256)
    named = changes.where("document_id IS NOT NULL AND sequence IS NOT NULL").select(
        "document_id", F.col("sequence").cast("long").alias("sequence"), (F.col("kind") != "delete").alias("alive"), "content", F.to_json("metadata").alias("metadata"), mark.alias("mark"), F.current_timestamp().alias("at")
    )
    wait = max(1, int(pd.Timedelta(forget).total_seconds() * 1000))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, content, alive, until = state.get if state.exists else (-1, "", None, 0)
        if alive is False and state.getCurrentWatermarkMs() >= until:  # due, though its timer hasn't come
            last, content, alive = -1, "", None
        best: Any = None
        for frame in frames:  # chunk by chunk: a document's changes are never held together
            row = frame.loc[frame["sequence"].idxmax()]
            if row["sequence"] > last and (best is None or row["sequence"] > best["sequence"]):
                best = row
        if best is None:
            if alive is False:  # a call without one ends a timer
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
            return
        now_alive = bool(best["alive"])
        until = 0 if now_alive else int(best["at"].timestamp() * 1000) + wait
        state.update((int(best["sequence"]), best["mark"] if now_alive else "", now_alive, until))
        if not now_alive:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if now_alive != alive or now_alive and best["mark"] != content:
            yield pd.DataFrame([{"document_id": key[0], "sequence": best["sequence"], "alive": now_alive, "content": best["content"], "metadata": best["metadata"]}])

    # the time of a batch is its own: a row is never late, and a batch that runs again has the time that it had
    told = named.withWatermark("at", "1 second").groupBy("document_id").applyInPandasWithState(
        step, "document_id string, sequence long, alive boolean, content string, metadata string", "sequence long, mark string, alive boolean, until long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return told.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def sync_effective(engine, source, changes: DataFrame, checkpoint: str, name: str = "sync", once: bool = False, **state) -> StreamingQuery:
    """Feed a stream of changes to ``engine.sync``, each effective change once, through kills and restarts.

    A batch's number is the key of its change set. If a batch is run again whose
    change set was committed already, by this engine or the one that died, its
    receipt is found and nothing is done. Whether a change adds or updates is
    decided by what the source holds; a deletion of what isn't there is left out.
    """
    from ..engine import ChangeSet

    def one(batch: DataFrame, number: int) -> None:
        key = f"{name}:{number}"
        if engine.knows(source.descriptor.ref, key):
            batch.write.format("noop").mode("overwrite").save()  # the states of all its rows are committed with the batch
            return
        here = source.state(source.latest().version)[0].select("document_id", F.lit(True).alias("_here"))
        resolved = batch.join(here, "document_id", "left").withColumn("kind", F.when(~F.col("alive"), "delete").when(F.col("_here"), "update").otherwise("add"))
        resolved = resolved.where("alive OR _here").select("kind", "document_id", F.when(F.col("alive"), F.col("content")).alias("content"), "metadata").persist()
        try:
            if resolved.count():  # all rows, for their states
                engine.sync(ChangeSet(source.descriptor.ref, resolved, key))
        finally:
            resolved.unpersist()

    writer = effective_changes(changes, **state).writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
