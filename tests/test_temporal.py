"""As-of joins against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from planeframe.operators.temporal import asof_join

DAY = datetime(2024, 1, 1)


def brute(left, right, direction, strict, tolerance, how):
    out = []
    for k, t, x in left:
        best = None
        for rk, rt, v in right:
            if None in (k, t, rk, rt) or k != rk:
                continue
            gap = t - rt if direction == "backward" else rt - t
            if gap < timedelta(0) or strict and not gap or tolerance is not None and gap > timedelta(seconds=tolerance):
                continue
            if best is None or (gap, -1 if v is None else -v) < best[0]:
                best = ((gap, -1 if v is None else -v), v)
        if best or how == "left":
            out.append((k, t, x, best and best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("direction", "strict", "tolerance", "how", "stretch"), [("backward", False, None, "inner", 100_000), ("backward", True, 40.0, "left", 16), ("forward", False, 25.0, "left", 7), ("forward", True, None, "inner", 30)])
def test_asof_join(spark, direction, strict, tolerance, how, stretch):
    """One key holds most rows; stretches are shorter than it, some without right rows."""
    rnd = random.Random(stretch)
    key = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    when = lambda: None if rnd.random() < 0.05 else DAY + timedelta(seconds=rnd.choice([rnd.randint(0, 300), rnd.randint(5000, 5010)]))
    left = [(key(), when(), rnd.randint(0, 3)) for _ in range(300)]
    right = [(key(), when(), i if i % 9 else None) for i in range(60)]
    left += left[:5]
    a = spark.createDataFrame(left, "k string, t timestamp, x int").repartition(3)
    b = spark.createDataFrame(right, "k string, at timestamp, x int").repartition(2)
    b = b.withColumnRenamed("at", "t")
    got = asof_join(a, b, ["k"], "t", "t", ["x"], direction, strict, tolerance, how, stretch)
    assert got.columns == ["k", "t", "x", "right_x"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, direction, strict, tolerance, how)


def test_asof_join_of_nothing(spark):
    a = spark.createDataFrame([("k", 5)], "k string, t int")
    none = spark.createDataFrame([], "k string, t int, v int")
    assert asof_join(a, none, ["k"], "t", "t", ["v"]).count() == 0
    assert [tuple(r) for r in asof_join(a, none, ["k"], "t", "t", ["v"], how="left").collect()] == [("k", 5, None)]
    assert asof_join(none, a, ["k"], "t", "t", ["t"], how="left").count() == 0


def test_a_hot_key_is_many_tasks(spark):
    """Rows of one key are numbered in windows of its stretches, of which there are many."""
    a = spark.range(5000).selectExpr("'hot' as k", "id as t")
    b = spark.range(0, 5000, 7).selectExpr("'hot' as k", "id as t", "id as v")
    plan = asof_join(a, b, ["k"], "t", "t", ["v"], stretch=200)
    assert plan.where("t - v not between 0 and 6").count() == 0 and plan.count() == 5000
