"""Project, Filter, Join, Fuse, Compose against plain Python models of their semantics."""

import random

import pytest
from pyspark.sql import functions as F

from planeframe.errors import ExecutionError
from planeframe.functions.text import lexical_score
from planeframe.operators import Relation, compose_evidence, dataflow, filter_rows, fuse, join_pairs, join_rows, project
from planeframe.operators.relation import EVIDENCE, IDS, ORDER, ranked
from planeframe.queries import QUERIES

SCHEMA = "k string, n long, b boolean, tags array<string>"
ROWS = [("x", 1, True, ["a", None]), (None, 2, False, []), ("y", None, None, ["b"]), ("x", 1, True, ["a"]), ("", 0, True, ["c", "a"])]


def relation(spark, rows=ROWS, schema=SCHEMA):
    df = spark.createDataFrame([(*r, i, [f"e{i}"]) for i, r in enumerate(rows)], f"{schema}, {ORDER} long, {IDS} array<string>")
    return Relation(tuple(c.split()[0] for c in schema.split(", ")), df)


@pytest.mark.parametrize(
    ("field", "op", "value", "want"),
    [
        ("k", "eq", "x", [0, 3]), ("k", "eq", None, [1]), ("k", "ne", "x", [1, 2, 4]), ("k", "eq", 1, []), ("k", "ne", 1, [0, 1, 2, 3, 4]), ("n", "eq", 1.0, [0, 3]), ("n", "eq", True, [0, 3]), ("b", "eq", 1, [0, 3, 4]),
        ("n", "in", [1, None], [0, 2, 3]), ("k", "in", [1, "y"], [2]), ("tags", "contains", "a", [0, 3, 4]), ("tags", "contains", None, [0]), ("k", "in", [], []),
    ],
)
def test_filter(spark, field, op, value, want):
    got = filter_rows(relation(spark), field, op, value).rows.select(ORDER).collect()
    assert sorted(r[0] for r in got) == want


def test_ordered_comparisons_fail_on_null_and_mixed_types(spark):
    r = relation(spark, [r for r in ROWS if r[1] is not None])
    assert sorted(x[0] for x in filter_rows(r, "n", "ge", 1).rows.select("n").collect()) == [1, 1, 2]
    with pytest.raises(Exception, match="n is null"):
        filter_rows(relation(spark), "n", "lt", 5).rows.collect()
    with pytest.raises(ExecutionError):
        filter_rows(r, "k", "lt", 5)
    with pytest.raises(ExecutionError):
        filter_rows(r, "n", "contains", 5)
    with pytest.raises(ExecutionError):
        filter_rows(r, "k", "in", "x")
    with pytest.raises(ExecutionError, match="no fields"):
        project(r, ["nope"])


def test_project_keeps_duplicates_and_order(spark):
    assert [tuple(r) for r in project(relation(spark), ["n", "k"]).public().collect()] == [(1, "x"), (2, None), (None, "y"), (1, "x"), (0, "")]


def test_join_matches_model(spark):
    rnd = random.Random(4)
    a = [(rnd.choice(["p", "q", None]), rnd.choice([1, 2, None])) for _ in range(12)]
    b = [(rnd.choice(["p", "q", None]), rnd.choice([1, 2, None])) for _ in range(9)]
    want = [(*x, *y) for x in a for y in b if None not in (*x, *y) and x == y]
    j = join_rows(relation(spark, a, "s string, n long"), relation(spark, b, "s string, n long"), ["s", "n"], ["s", "n"])
    assert [tuple(r) for r in j.public().collect()] == want
    assert j.fields == ("left.s", "left.n", "right.s", "right.n")
    assert not join_rows(relation(spark, a, "s string, n long"), relation(spark, b, "s string, n long"), ["s"], ["n"]).rows.count()
    with pytest.raises(ExecutionError):
        join_rows(relation(spark), relation(spark), ["tags"], ["tags"])


@pytest.mark.parametrize("sizes", [(8, 4, 3), (1, 1, 1), (4096, 16, 256)])
def test_join_pairs_matches_model(spark, monkeypatch, sizes):
    for name, n in zip(("TILE", "STRETCH", "RUN"), sizes, strict=True):
        monkeypatch.setattr(dataflow, name, n)
    rnd = random.Random(6)
    a = [(rnd.choice(["p", "p", "q", "only here", None]), rnd.choice([*range(40), None])) for _ in range(150)]
    b = [(rnd.choice(["p", "q", "only there", None]), rnd.choice(["x", "y", None])) for _ in range(60)]
    want = sorted(((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0]), key=str)
    left, right = spark.createDataFrame(a, "k string, a long").repartition(3), spark.createDataFrame(b, "k string, b string").repartition(2)
    got = join_pairs(left, right, "k", "a", "b")
    assert got.columns == ["a", "b"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert join_pairs(left, right.where("false"), "k", "a", "b").count() == join_pairs(left.where("k IS NULL"), right, "k", "a", "b").count() == 0


def test_pairs_take_little_room_and_several_tasks(spark, tmp_path):
    """Few keys with many rows on both sides: one task wrote them all, a byte and more for each pair, while all suppliers came in turn."""
    nation = "cast(pmod(hash(id), 25) AS int)"
    spark.range(1_250).selectExpr("id AS c_custkey", f"{nation} AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(20_000).selectExpr("id AS s_suppkey", f"{nation} AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    QUERIES["join_null_keys"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path / "out"))
    all_ = spark.range(1_250).selectExpr("id AS c", f"{nation} AS k").join(spark.range(20_000).selectExpr("id AS s", f"{nation} AS k"), "k").where("k <> 3")
    assert got.count() == got.distinct().count() == all_.count() > 900_000
    assert got.where("pmod(hash(c), 25) <> pmod(hash(s), 25) OR pmod(hash(c), 25) = 3").count() == 0
    assert len(files) > 1
    assert sum(f.stat().st_size for f in files) < 0.5 * got.count()


def evidence(spark, items):
    rows = [(f"id-{loc}-{v}", "document", f"text {loc}", "s", loc, v, None, None, 1.0, None, i) for i, (loc, v) in enumerate(items)]
    return spark.createDataFrame(rows, EVIDENCE)


def test_fuse_matches_model(spark):
    rnd = random.Random(7)
    lists = [[(rnd.choice("abcdefgh"), rnd.choice(["v1", None])) for _ in range(rnd.randint(1, 9))] for _ in range(3)]
    score, first = {}, {}
    for i, items in enumerate(lists):
        for rank, key in enumerate(items, 1):
            score[key] = score.get(key, 0.0) + 1 / (60 + rank)
            first.setdefault(key, (i, rank))
    want = [(k[0], k[1], round(score[k], 12)) for k in sorted(score, key=lambda k: (-score[k], first[k]))][:5]
    got = fuse([evidence(spark, x) for x in lists], limit=5).orderBy(ORDER)
    assert [(r["locator"], r["version"], r["score"]) for r in got.collect()] == want


def test_compose_keeps_first(spark):
    got = compose_evidence([evidence(spark, [("a", "1"), ("b", "1")]), evidence(spark, [("b", "1"), ("c", "1")])]).orderBy(ORDER)
    assert [r["locator"] for r in got.collect()] == ["a", "b", "c"]


def test_lexical_score(spark):
    df = spark.createDataFrame([("Die Straße, weiß",), ("STRASSE",), (None,), ("",), ("x_1 naïve",)], "t string")
    assert [r[0] for r in df.select(lexical_score("t", "strasse weiss zzz")).collect()] == [round(2 / 3, 8), round(1 / 3, 8), 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(lexical_score("t", "naïve")).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert df.select(F.max(lexical_score("t", ", "))).first()[0] == 1.0


def test_ranks_of_parts(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.randrange(10_000), i) for i in range(500)], "v long, i long").repartition(5)
    got = sorted((r["_rank"], r["v"], r["i"]) for r in ranked(df, F.shiftright("v", 10), F.col("v"), F.col("i")).collect())
    assert [r[0] for r in got] == list(range(1, 501))
    assert [r[1:] for r in got] == sorted((r["v"], r["i"]) for r in df.collect())
    assert ranked(df.where("false"), F.shiftright("v", 10), F.col("v")).count() == 0
