"""The pipeline's stages against their operators' brute-force meaning, and the queries' SQL on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    return None if v is None else str(v)


def test_stages(spark, tmp_path):
    from planeframe.llm import pii, quality, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert all(d.columns == docs.columns for d in seen[:-1])
    scored = toxicity.toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    assert ids[1] == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    assert ids[2] == {r[0] for r in quality.quality_rules(seen[1]).where("kept").select("doc_id").collect()}
    from test_corpus_operators import base_spans, brute_classes

    rows = sorted((r["doc_id"], r["text"]) for r in seen[2].collect())
    classes = brute_classes([t for _, t in rows], 4, 85)
    assert ids[3] == {rows[i][0] for i, (_, c) in enumerate(classes) if c == i}
    for r in seen[4].collect():
        assert not base_spans(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert pii.redact(seen[3]).where(F.col("text").contains("[")).count() > 0
    assert ids[5] == ids[4]
    assert corpus_pipeline.run(spark, DATA).count() == seen[5].count()


def test_near_copies_without_ids_or_with_repeated_ids(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("c")), (5, text("c") + " more"), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("e")), (9, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"].split()[0]) for r in got.collect()), key=str)
    assert kept == sorted([(None, "a0"), (None, "b0"), (5, "c0"), (7, "d0"), (7, "e0"), (9, "f0")], key=str)


ROWS = [
    (1, "plain words of a text " * 30, "en", "s", 660), (1, "plain words of a text " * 30, "en", "s", 660), (None, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t", None, "s", 3), (None, "mail a@b.cd now", "en", "s", 15),
    ((1 << 60) + 1, "x" * 200_000, "en", "s", 200_000), (4, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 1), (5, None, "fr", "s", 0),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in all columns, empty and very long texts, repeated rows; and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(ROWS, schema).repartition(3)
    got = stage(spark, docs, DATA).collect()
    assert stage(spark, docs.where("false"), DATA).count() == 0
    rows = sorted((tuple(r)[:2] for r in got), key=str)
    given = sorted((r[:2] for r in ROWS), key=str)
    if name == "toxicity":
        assert rows == given  # none is toxic: a text without words is like a clean one
    elif name == "quality_rules":
        assert all(len((t or "").split()) >= 50 for _, t in rows)
    elif name == "ngram_join":
        assert rows == sorted(set(given), key=str)  # repeated rows are one
    elif name == "pii":
        assert rows == sorted(((i, t and t.replace("a@b.cd", "[EMAIL]")) for i, t in given), key=str)
    else:
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in ROWS)
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
        assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_ngram_join", "op8_embedding_dedup"])
def test_oracles(spark, name):
    import duckdb

    from planeframe.llm import queries

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    res = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(x)]) for x in cols) for r in res.fetchall())
    assert sorted(tuple(plain(r[x]) for x in cols) for r in df.collect()) == want
