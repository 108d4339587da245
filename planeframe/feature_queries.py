"""Queries of the index, stored versions, as-of joins, streams, sketches, samples and nested JSON, with their SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Catalog, ChangeSet, Engine
from .engine_queries import folder
from .functions.sketches import KLL_ERROR, estimates, hll_error, merged, sketches
from .functions.variants import shredded
from .operators.sampling import melted, pivoted, share_sample, stratified_sample
from .operators.temporal import asof_join
from .plans import Search
from .queries import MEMORIES, _search_sql, documents, memories, query, table
from .sources import SkillSource, SkillSpec, StoredDocuments
from .sources.history import broken
from .sources.postings import Postings
from .streaming.changes import sync_effective
from .streaming.windows import as_stream, event_windows, run

# --- index


@query(
    f"SELECT 0 AS query, * FROM ({_search_sql('the and zzz', 'documents', 'doc_id::VARCHAR', 'text')}) UNION ALL SELECT 1, * FROM ({_search_sql('of the', 'documents', 'doc_id::VARCHAR', 'text', 'true', 50)})"
    f" UNION ALL SELECT 2, * FROM ({_search_sql('heat tion stupid', 'documents', 'doc_id::VARCHAR', 'text', 'lang = $$en$$')}) UNION ALL SELECT 3, * FROM ({_search_sql('thi', 'documents', 'doc_id::VARCHAR', 'text', 'true', 30)})"
)
def search_index(spark, sf_dir) -> DataFrame:
    """Four searches at once over the posting blocks of all documents."""
    index = Postings.build(documents(spark, sf_dir), folder(spark))
    asked = [("the and zzz", 20, None), ("of the", 50, None), ("heat tion stupid", 20, {"lang": "en"}), ("thi", 30, None)]
    return index.search_many(asked).select("query", "document_id", "score")


_AFTER = "(SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'the new text' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 2)"


@query(_search_sql("new text", _AFTER, "doc_id::VARCHAR", "text", "true", 40))
def search_index_after_sync(spark, sf_dir) -> DataFrame:
    """A stored source's index follows a change set that updates a seventh of the documents and deletes another."""
    kb = StoredDocuments(spark, "kb", folder(spark), documents(spark, sf_dir), buckets=8, index=True)
    engine, d = Engine(spark, Catalog(kb)), documents(spark, sf_dir).withColumn("k", F.col("document_id").cast("long") % 7)
    changed = d.where("k = 1").select(F.lit("update").alias("kind"), "document_id", F.lit("the new text").alias("content"), "metadata")
    gone = d.where("k = 2").select(F.lit("delete").alias("kind"), "document_id", F.lit(None).cast("string").alias("content"), "metadata")
    engine.sync(ChangeSet(kb.ref, changed.unionByName(gone), "k"))
    return engine.execute(Search(source=kb.ref, query="new text", limit=40)).bindings().select("document_id", "score")


# --- stored versions and histories


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE lang END AS content, count(*) AS n, true AS same_again FROM documents GROUP BY ALL")
def stored_versions(spark, sf_dir) -> DataFrame:
    """A version after a change set, read by another engine; the change undone gives the first version again."""
    where = folder(spark)
    docs = documents(spark, sf_dir).withColumn("content", F.col("metadata")["lang"])
    kb = StoredDocuments(spark, "kb", where, docs, buckets=8)
    change = lambda text: documents(spark, sf_dir).where("cast(document_id as long) % 5 = 0").select(F.lit("update").alias("kind"), "document_id", text.alias("content"), "metadata")
    engine, first = Engine(spark, Catalog(kb)), kb.latest().version
    second = engine.sync(ChangeSet(kb.ref, change(F.lit("changed")), "a", first)).after.version
    third = engine.sync(ChangeSet(kb.ref, change(F.col("metadata")["lang"]), "b")).after.version
    other = StoredDocuments(spark, "kb", where)
    return other.state(second)[0].groupBy("content").agg(F.count("*").alias("n")).withColumn("same_again", F.lit(first == third == other.latest().version))


@query(f"WITH {MEMORIES} SELECT 'repeated' AS rule, count(*) AS n FROM (SELECT memory_id FROM m WHERE scope_id = '1') UNION ALL SELECT 'missing', count(*) FROM m WHERE scope_id = '2'")
def history_broken(spark, sf_dir) -> DataFrame:
    """Faults put into a memory: the records of one scope stand twice, those of another link to what isn't there."""
    m = memories(spark, sf_dir).withColumn("links", F.expr("cast(array() as array<struct<kind:string,target_id:string>>)"))
    lost = F.array(F.struct(F.lit("contradicts").alias("kind"), F.lit("nowhere").alias("target_id")))
    faulty = m.withColumn("links", F.when(F.col("scope.scope_id") == "2", lost).otherwise(F.col("links"))).unionByName(m.where("scope.scope_id = '1'"))
    found = broken(faulty).where("rule IN ('repeated', 'missing')").groupBy("rule").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("repeated",), ("missing",)], "rule string").join(found, "rule", "left").fillna(0)


# --- time


@query(
    "SELECT a.event_id, b.event_id AS last_purchase, b.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') a"
    " ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts"
)
def asof_last_purchase(spark, sf_dir) -> DataFrame:
    """Each event with its user's last purchase before it."""
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"))
    return asof_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["last_purchase", "last_value"]).select("event_id", "last_purchase", "last_value")


@query(
    "SELECT o_orderkey, e.event_id FROM orders ASOF LEFT JOIN (SELECT 1 AS one, event_id, ts FROM events) e ON e.one = 1 AND o_orderdate <= e.ts"
)
def asof_next_event(spark, sf_dir) -> DataFrame:
    """Each order with the first event at or after it, of any user: one key holds all rows."""
    o, e = table(spark, sf_dir, "orders").withColumn("one", F.lit(1)), table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return asof_join(o, e, ["one"], "o_orderdate", "ts", ["event_id"], "forward", how="left", stretch=4096).select("o_orderkey", "event_id")


def _windows(spark, sf_dir, **shape) -> DataFrame:
    where = folder(spark)
    stream = as_stream(table(spark, sf_dir, "events").select("ts", "event_type", "value"), where, "ts")
    told = event_windows(stream, "ts", {"n": F.count("*"), "most": F.max("value")}, ("event_type",), delay="400 days", **shape)
    bounds = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return run(told, f"{where}/told").rows.withColumns(bounds)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir) -> DataFrame:
    """Days of events by type, as a stream tells them."""
    return _windows(spark, sf_dir, size="1 day")


@query(
    "SELECT s AS window_start, s + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, max(value) AS most FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL"
)
def stream_sliding(spark, sf_dir) -> DataFrame:
    """Every two days of events that follow each other, as a stream tells them."""
    return _windows(spark, sf_dir, size="2 days", slide="1 day")


@query(
    "SELECT min(ts) AS window_start, max(ts) + INTERVAL 90 MINUTE AS window_end, event_type, count(*) AS n, max(value) AS most FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM"
    " (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY event_type, session"
)
def stream_sessions(spark, sf_dir) -> DataFrame:
    """Sessions of events of a type, apart by 90 minutes, as a stream tells them."""
    return _windows(spark, sf_dir, gap="90 minutes")


@query(
    "SELECT user_id::VARCHAR AS document_id, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'purchase'"
)
def stream_sync(spark, sf_dir) -> DataFrame:
    """Events as changes of documents, a document for each user: a purchase deletes it, any other event writes its type; through state and change sets into a stored source."""
    where = folder(spark)
    kb = StoredDocuments(spark, "kb", f"{where}/kb", documents(spark, sf_dir).where("false"), buckets=8)
    e = table(spark, sf_dir, "events")
    changes = e.select(F.when(F.col("event_type") == "purchase", "delete").otherwise("update").alias("kind"), F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("event_id").alias("sequence"))
    changes.repartition(6).write.parquet(f"{where}/changes")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", "2").parquet(f"{where}/changes")
    sync_effective(Engine(spark, Catalog(kb)), kb, stream, f"{where}/checkpoint", once=True).awaitTermination()
    return kb.state(kb.latest().version)[0].select("document_id", "content")


# --- sketches, samples, nested values


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS quantiles_near FROM events GROUP BY ALL")
def sketch_rollup(spark, sf_dir) -> DataFrame:
    """Sketches of users and values by type and day, kept as a table and merged by type, against the exact counts and ranks."""
    e, path = table(spark, sf_dir, "events"), f"{folder(spark)}/sketches"
    sketches(e.withColumn("day", F.to_date("ts")), ("event_type", "day"), ("user_id",), ("value",)).write.parquet(path)
    at = (0.1, 0.5, 0.9)
    told = estimates(merged(spark.read.parquet(path), ("event_type",)), ("event_type",), at)
    near = [F.abs(F.avg(F.when(F.col("value") <= F.col("quantiles_value")[k], 1.0).otherwise(0.0)) - q) <= 2 * KLL_ERROR + 1 / F.count("*") for k, q in enumerate(at)]
    exact = e.join(told.select("event_type", "quantiles_value"), "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), (near[0] & near[1] & near[2]).alias("quantiles_near"))
    return told.join(exact, "event_type").select("event_type", "n", "users", (F.abs(F.col("distinct_user_id") - F.col("users")) <= 4 * hll_error() * F.col("users")).alias("users_near"), "quantiles_near")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('5|=' || event_id)) AS k FROM events) WHERE k <= 25")
def sample_stratified(spark, sf_dir) -> DataFrame:
    return stratified_sample(table(spark, sf_dir, "events"), ("event_type",), ("event_id",), 25, seed=5).select("event_type", "event_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE md5('1|=' || l_orderkey) < '1999999999999800' GROUP BY ALL")
def sample_share(spark, sf_dir) -> DataFrame:
    """All lines of a tenth of the orders."""
    return share_sample(table(spark, sf_dir, "lineitem"), ("l_orderkey",), 0.1, 1).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click_n, max(value) FILTER (event_type = 'click') AS click_most, count(*) FILTER (event_type = 'purchase') AS purchase_n, max(value) FILTER (event_type = 'purchase') AS purchase_most FROM events GROUP BY ALL")
def pivot_events(spark, sf_dir) -> DataFrame:
    return pivoted(table(spark, sf_dir, "events"), ("user_id",), "event_type", ["click", "purchase"], {"n": F.count("event_id"), "most": F.max("value")}).fillna(0, ["click_n", "purchase_n"])


@query("SELECT o_orderkey, name, value FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME name VALUE value)")
def melt_orders(spark, sf_dir) -> DataFrame:
    return melted(table(spark, sf_dir, "orders"), ("o_orderkey",), ("o_orderstatus", "o_orderpriority"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_shredded(spark, sf_dir) -> DataFrame:
    """The leaves of all events' properties as columns, by the schema that all of them have in common."""
    return shredded(table(spark, sf_dir, "events"), "props").select("event_id", "k")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS label, length(event_type) AS size FROM events")
def invoke_skill_batches(spark, sf_dir) -> DataFrame:
    """A skill over Arrow batches of all events, checked against its schemas."""
    spec = SkillSpec(
        "grade", "1.0.0", input_schema={"properties": {"value": {"type": "number"}, "kind": {"type": "string"}}, "required": ["value", "kind"], "additionalProperties": False},
        output_schema={"properties": {"label": {"type": "string"}, "size": {"type": "integer"}}, "required": ["label", "size"]},
    )

    def grade(t: pa.Table) -> pa.Table:
        return pa.table({"label": pc.if_else(pc.greater(t["value"], 50), "high", "low"), "size": pc.utf8_length(t["kind"])})

    s = SkillSource(spark, "skills", [(spec, None)], batches={"grade": grade})
    return s.apply_batches(table(spark, sf_dir, "events"), spec.ref, value=F.col("value"), kind=F.col("event_type")).select("event_id", "output.label", "output.size")
