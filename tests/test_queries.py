"""Every registered query against DuckDB on the smallest tables, and the layers' imports."""

import ast
import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from planeframe import engine_queries, feature_queries, queries  # noqa: F401
from planeframe.engine import Catalog, Engine
from planeframe.plans import Plan, Query, Ref, Traverse
from planeframe.plans.codec import plan_from_json, plan_to_json
from planeframe.sources import GraphSource, TableSource

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    return None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want


def test_multi_key_join_of_whole_tables(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    got = queries.QUERIES["join_multi_key_whole"](spark, DATA)
    key = ["l_orderkey", "l_linenumber", "l_suppkey"]
    assert got.count() == lines.count()
    assert lines.select(key).exceptAll(got.select(key)).count() == 0


def test_composed_rankings_are_whole(spark):
    assert queries.QUERIES["compose_union_whole"](spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count() > 1000


def test_plans_have_no_row_limit_below_them(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "TableSource", lambda *a, **k: seen.append(k.get("row_limit", 1000)) or TableSource(*a, **k))
    monkeypatch.setattr(queries, "Traverse", lambda **k: seen.append(k["limit"]) or Traverse(**k))
    queries.QUERIES["plan_search_query_join"](spark, DATA)
    assert seen == [None]
    queries.QUERIES["plan_bound_traversal"](spark, DATA)
    assert seen[-1] is None


def test_no_limit_gives_every_row(spark):
    e = spark.createDataFrame([(f"e{i}", f"a{i}", "n", "r") for i in range(150)], "edge_id string, source_id string, target_id string, relation string")
    ids = e.select(F.col("source_id").alias("node_id")).union(e.select("target_id").distinct())
    w, g = TableSource(spark, "w", {"t": spark.range(1500).toDF("a")}, row_limit=None), GraphSource("g", ids, e)
    plan = Plan((Query(op_id="q", source=w.ref, statement="SELECT a FROM t"),), Ref("q"))
    assert Engine(spark, Catalog(w)).execute(plan).relation.rows.count() == 1500
    plan = Plan((Traverse(op_id="t", source=g.ref, starts=("n",), direction="in", max_hops=1, limit=None),), Ref("t"))
    assert plan_from_json(plan_to_json(plan)) == plan
    assert Engine(spark, Catalog(g)).execute(plan).relation.rows.count() == 150


def test_case_folding_of_every_letter(spark, tmp_path):
    """Letters whose other case Spark has as several, sigmas at the end of words, and all other characters, 36 in a text."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["straße weiß", "ŉ ǰ ΐ և ﬁ", "ΟΔΟΣ ΣΑΣ.", "İstanbul", "ᾀ ᾳ ᾼ ᾲ", "ǆ ǅ Ǆ", "", *("".join(every[i : i + 36]) for i in range(0, len(every), 36))]
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "documents":
            (tmp_path / p.name).symlink_to(p)
    rows = [*((i, t, "fr" if i % 2 else "es") for i, t in enumerate(texts)), (-1, None, "fr"), (-2, "ß", "de"), (-3, "ß", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["u"], r["l"]) for r in queries.QUERIES["query_case_folding"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in c.execute(queries.ORACLE_SQL["query_case_folding"]).fetchall()}
    assert got[0] == ("STRAẞE WEIẞ", "straße weiß")
    assert len(got) == len(texts)
    assert got == want


def test_nothing_imports_the_corpus_operators():
    root = Path(queries.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f
