"""Windows over streams with late data; changes as a stream with state, through kills and restarts."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from planeframe.engine import Catalog, Engine
from planeframe.sources import StoredDocuments
from planeframe.streaming.changes import TOLD, effective_changes, sync_effective
from planeframe.streaming.windows import as_stream, event_windows, run

T = datetime(2024, 1, 1)
EVENTS = "at timestamp, k string, v int"


def rows(spark, *data):
    return spark.createDataFrame([(T + timedelta(seconds=s), k, v) for s, k, v in data], EVENTS)


def aggregates():
    return {"n": F.count("*"), "total": F.sum("v")}



@pytest.mark.parametrize("shape", [{"size": "10 seconds"}, {"size": "20 seconds", "slide": "10 seconds"}, {"gap": "7 seconds"}])
def test_a_stream_tells_what_the_table_does(spark, tmp_path, shape):
    table = spark.createDataFrame([(T + timedelta(seconds=(i * 37) % 211), f"k{i % 3}" if i % 7 else None, i) for i in range(150)] + [(None, "k1", 1)], EVENTS)
    want = event_windows(table, "at", aggregates(), ("k",), **shape)
    stream = as_stream(table, str(tmp_path), "at", pieces=3)
    got = run(event_windows(stream, "at", aggregates(), ("k",), delay="1 minute", **shape), str(tmp_path / "out"))
    assert sorted(map(tuple, got.rows.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert (got.late, got.batches >= 1) == (0, True)


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed = lambda *data: rows(spark, *data).coalesce(1).write.mode("append").parquet(path)
    work = lambda: run(event_windows(spark.readStream.schema(EVENTS).parquet(path), "at", aggregates(), ("k",), size="10 seconds", delay="20 seconds"), out)
    feed((1, "a", 1), (12, "a", 2), (100, "a", 3))
    told = lambda r: sorted(((x["window_start"] - T).seconds, x["k"], x["n"], x["total"]) for x in r.rows.collect())
    assert told(work()) == [(0, "a", 1, 1), (10, "a", 1, 2)]
    # the watermark is at 80: 15 is too late, 85 isn't; the run goes on from the checkpoint
    feed((15, "a", 50), (85, "a", 7), (200, "b", 9))
    second = work()
    assert second.late == 1
    assert told(second) == [(0, "a", 1, 1), (10, "a", 1, 2), (80, "a", 1, 7), (100, "a", 1, 3)]


def test_windows_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([], EVENTS)
    assert event_windows(table, "at", aggregates(), size="1 minute").count() == 0
    assert run(event_windows(as_stream(table, str(tmp_path), "at"), "at", aggregates(), size="1 minute"), str(tmp_path / "out")).rows.count() == 0
    with pytest.raises(ValueError):
        event_windows(table, "at", aggregates())


CHANGE = "kind string, document_id string, content string, metadata map<string,string>, sequence long, at timestamp"


def write_changes(spark, path, *data):
    spark.createDataFrame([(k, d, c, {"n": str(s)} if k != "delete" and c != "same" else {}, s, T + timedelta(hours=h)) for k, d, c, s, h in data], CHANGE).coalesce(1).write.mode("append").parquet(path)


def test_effective_changes(spark, tmp_path):
    path, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))

    def work(forget="1 day"):
        stream = effective_changes(spark.readStream.schema(CHANGE).parquet(path), forget=forget)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["document_id"], r["sequence"], r["alive"], r["content"]) for r in spark.read.schema(TOLD).parquet(out).collect())

    write_changes(spark, path, ("add", "a", "one", 1, 0), ("add", "a", "two", 2, 0), ("add", "b", "same", 1, 0), ("delete", "c", None, 5, 0), (None, None, "x", 1, 0), ("add", "d", "new", None, 0))
    first = [("a", 2, True, "two"), ("b", 1, True, "same"), ("c", 5, False, None)]
    assert work() == first
    # again, older, equal content, a deletion, and one that comes late after it
    write_changes(spark, path, ("add", "a", "two", 2, 1), ("update", "a", "old", 1, 1), ("update", "b", "same", 9, 1), ("delete", "a", None, 3, 1))
    assert work() == [*first[:1], ("a", 3, False, None), *first[1:]]
    write_changes(spark, path, ("update", "a", "late", 2, 1))
    assert len(work()) == 4
    # the deletion is forgotten a while after it was told
    write_changes(spark, path, ("delete", "e", None, 7, 1), ("delete", "b", None, 10, 1))
    assert len(work("1 second")) == 6
    time.sleep(3)
    write_changes(spark, path, ("add", "f", "next", 1, 1))
    work("1 second")
    write_changes(spark, path, ("add", "e", "again", 2, 1), ("add", "c", "late", 4, 1))
    assert [r for r in work("1 second") if r[0] in "ce"] == [("c", 5, False, None), ("e", 2, True, "again"), ("e", 7, False, None)]


def test_sync_survives_a_kill(spark, tmp_path):
    """The engine dies after a change set was committed and before the batch was: another one goes on, and nothing is lost or done twice."""
    base = spark.createDataFrame([("a", "zero", {}), ("old", "x", {})], "document_id string, content string, metadata map<string,string>")
    folder, path, chk = (str(tmp_path / x) for x in ("kb", "in", "chk"))
    StoredDocuments(spark, "kb", folder, base, buckets=2)

    def engine(dies=False):
        kb = StoredDocuments(spark, "kb", folder)
        e = Engine(spark, Catalog(kb))
        real = e.sync

        def sync(change_set):
            real(change_set)
            raise RuntimeError("killed")

        if dies:
            e.sync = sync
        return e, kb

    def work(dies=False):
        e, kb = engine(dies)
        q = sync_effective(e, kb, spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(path), chk, once=True)
        q.awaitTermination()

    write_changes(spark, path, ("update", "a", "one", 1, 0), ("add", "b", "two", 1, 0), ("delete", "nowhere", None, 1, 0))
    with pytest.raises(Exception, match="killed"):
        work(dies=True)
    write_changes(spark, path, ("delete", "old", None, 1, 1), ("add", "b", "three", 2, 1))
    work()
    store = StoredDocuments(spark, "kb", folder).store
    assert [c.key for c in store.log()] == [None, "sync:0", "sync:1"]
    assert sorted((r["document_id"], r["content"]) for r in store.rows().collect()) == [("a", "one"), ("b", "three")]
