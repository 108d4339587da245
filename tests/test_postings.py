"""The inverted index gives what scanning gives, before and after change sets."""

import random

import pytest
from pyspark.sql import functions as F

from planeframe.sources import postings
from planeframe.sources.document import SCHEMA, apply_changes, search_frame
from planeframe.sources.postings import Postings

QUERIES = [
    ("alpha beta", 5, None), ("beta alpha", 40, {}), ("alp", 9, None), ("a", 7, None), ("ha b", 12, None), ("zz nothing", 5, None), ("Straße", 6, None), ("STRASSE gamma", 30, {"lang": "en"}),
    ("gamma", 10, {"lang": None}), ("gamma", 50, {"lang": "de", "src": "1"}), ("日本", 5, None), ("𝔘𝔫", 4, None), ("a, b", 5, None), ("alpha beta gamma delta", 60, None), ("\x01", 5, None),
]


def corpus(seed, n, start=0):
    rnd = random.Random(seed)
    say = ["alpha", "Beta", "gamma", "delta", "alphabet", "xalpha beta", "Straße", "STRASSE", "日本語", "𝔘𝔫𝔦", "a, b", "a", "", "\x01\n"]
    rows = []
    for i in range(start, start + n):
        text = None if i % 17 == 3 else rnd.choice([" ", "", " , "]).join(rnd.choice(say) for _ in range(rnd.randint(0, 6)))
        meta = {k: v for k, v in (("lang", rnd.choice(["en", "de", None])), ("src", str(i % 3))) if rnd.random() < 0.8}
        rows.append((f"d{i * 7919 % 1009}", text, meta))
    return rows


def told(df):
    return [(r["document_id"], r["content"], dict(r["metadata"]), r["score"]) for r in df.collect()]


@pytest.mark.parametrize(("run", "slice_"), [(1 << 16, 1 << 20), (2, 8)])
def test_index_searches_as_a_scan_does(spark, tmp_path, monkeypatch, run, slice_):
    monkeypatch.setattr(postings, "RUN", run)
    monkeypatch.setattr(postings, "SLICE", slice_)
    docs = spark.createDataFrame(corpus(1, 80), SCHEMA).repartition(3)
    index = Postings.build(docs, str(tmp_path))
    for q, n, f in QUERIES[:1]:
        assert told(index.search(q, n, f)) == told(search_frame(docs, q, n, f)), (q, n, f)
    many = index.search_many(QUERIES).orderBy("query", F.desc("score"), "document_id").collect()
    for k, (q, n, f) in enumerate(QUERIES):
        assert [(r["document_id"], r["score"]) for r in many if r["query"] == k] == [(r[0], r[3]) for r in told(search_frame(docs, q, n, f))]


def test_index_follows_change_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENTS", 2)
    docs = spark.createDataFrame(corpus(1, 60), SCHEMA)
    index = Postings.build(docs, str(tmp_path))
    for step in range(3):
        have = [r[0] for r in docs.select("document_id").orderBy("document_id").collect()]
        rnd = random.Random(step)
        some = rnd.sample(have, 9)
        new = corpus(10 + step, 5, 200 + 10 * step)
        changes = [("delete", d, None, {}) for d in some[:3]] + [("update", d, t, m) for d, (_, t, m) in zip(some[3:], corpus(20 + step, 6), strict=True)] + [("add", f"n{step}-{d}", t, m) for d, t, m in new]
        changes = spark.createDataFrame(changes, "kind string, " + SCHEMA)
        docs, index = spark.createDataFrame(apply_changes(docs, changes).collect(), SCHEMA), index.extended(changes)
        key = F.xxhash64("document_id", "content", F.array_sort(F.map_entries("metadata")))
        assert sorted(r[0] for r in index.docs().select(key).collect()) == sorted(r[0] for r in docs.select(key).collect())
        for q, n, f in QUERIES[1 + step :: 6]:
            assert told(index.search(q, n, f)) == told(search_frame(docs, q, n, f)), (step, q, n, f)
    assert len(index.segments) <= 2


def test_search_reads_the_row_groups_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:05d}", f"word{i} common", {}) for i in range(3000)], SCHEMA)
    index = Postings.build(docs, str(tmp_path))
    plan = index.search("word77 common", 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,w)" in plan or "In(term" in plan
    assert [r["document_id"] for r in index.search("word77", 5).collect()] == ["d00077", *[f"d{i:05d}" for i in range(770, 774)]]


def test_index_of_nothing(spark, tmp_path):
    index = Postings.build(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert index.search("alpha", 5).count() == 0
    more = index.extended(spark.createDataFrame([("add", "x", "alpha", {})], "kind string, " + SCHEMA))
    assert [r["document_id"] for r in more.search("alpha", 5).collect()] == ["x"]
