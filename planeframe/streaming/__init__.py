"""Change sets from a stream: each micro-batch is one change set of a document source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sync_stream(engine, source, changes: DataFrame, checkpoint: str, order_col: str = "sequence", name: str = "sync") -> StreamingQuery:
    """Feed a stream of changes (kind, document_id, content, metadata, a sequence) to ``engine.sync``.

    Of several changes of a document within a batch the last one counts. The
    batch's number is part of the idempotency key, so a batch that is run again
    after a failure changes nothing.
    """
    from ..engine import ChangeSet

    def one(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(order_col)))).where("_n = 1").drop("_n", order_col)
        if last.limit(1).count():
            engine.sync(ChangeSet(source.descriptor.ref, last, f"{name}:{number}"))

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).start()
