"""Sketches, samples, pivots, nested JSON, skills over batches."""

import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from planeframe.errors import EffectPolicyError, ExecutionError
from planeframe.functions.sketches import KLL_ERROR, estimates, hll_error, merged, sketches
from planeframe.functions.variants import inferred, shredded
from planeframe.model import EffectLevel
from planeframe.operators.sampling import melted, pivoted, share_sample, stratified_sample
from planeframe.sources import SkillSource, SkillSpec


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    rnd = random.Random(2)
    data = [(f"g{min(rnd.randint(0, 9), 2)}", i % 2, rnd.randint(0, 20_000), rnd.gauss(0, 10) if i % 50 else None) for i in range(60_000)] + [("g0", 0, None, float("nan"))]
    df = spark.createDataFrame(data, "g string, day int, u int, v double").repartition(6)
    sketches(df, ("g", "day"), ("u",), ("v",)).write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert kept.count() == 6
    for keys in (("g",), (), ("g", "day")):
        got = estimates(merged(kept, keys), keys, (0.0, 0.25, 0.5, 0.99)).collect()
        for r in got:
            rows = [x for x in data if all(x[("g", "day").index(k)] == r[k] for k in keys)]
            assert r["n"] == len(rows)
            exact = len({x[2] for x in rows} - {None})
            assert abs(r["distinct_u"] - exact) <= 4 * hll_error() * exact
            line = sorted(x[3] for x in rows if x[3] is not None and x[3] == x[3])
            for q, v in zip((0.0, 0.25, 0.5, 0.99), r["quantiles_v"], strict=True):
                assert abs(sum(x <= v for x in line) / len(line) - q) <= 2 * KLL_ERROR + 1 / len(line)
    none = estimates(merged(sketches(df.where("v IS NULL AND g = 'g1'"), ("g",), ("u",), ("v",)), ("g",)), ("g",)).collect()
    assert [r["quantiles_v"] for r in none] == [None]
    assert merged(sketches(df.where("false"), ("g",), ("u",), ("v",)), ("g",)).count() == 0


def test_samples_are_the_same_on_any_partitioning(spark):
    data = [("hot" if i % 3 else f"s{i % 5}" if i % 2 else None, i, i % 4) for i in range(500)]
    df = spark.createDataFrame(data, "s string, id int, x int")
    lots = lambda i: hashlib.md5(f"7|={i}".encode()).hexdigest()
    want = {}
    for s, i, x in data:
        want.setdefault(s, []).append((lots(i), s, i, x))
    want = {r[1:] for v in want.values() for r in sorted(v, key=lambda r: r[0])[:10]}
    for n in (1, 7):
        sample = stratified_sample(df.repartition(n), ("s",), ("id",), 10, seed=7)
        assert {tuple(r) for r in sample.collect()} == want
    halves = [stratified_sample(df.where(c), ("s",), ("id",), 10, seed=7) for c in ("id < 200", "id >= 200")]
    assert {tuple(r) for r in stratified_sample(halves[0].union(halves[1]), ("s",), ("id",), 10, seed=7).collect()} == want
    plan = sample._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the shuffle
    some = {r["id"] for r in share_sample(df, ("id",), 0.3, 7).collect()}
    assert some == {i for _, i, _ in data if lots(i) < format(int(0.3 * 2**64), "016x")} and 90 < len(some) < 210
    assert share_sample(df, ("id",), 1).count() == 500 and share_sample(df, ("id",), 0).count() == 0


def test_pivot_and_melt(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4), ("b", "z", 5)], "k string, n string, v int")
    wide = pivoted(df, ("k",), "n", ["x", "y"], {"sum": F.sum("v")}).orderBy("k")
    assert wide.columns == ["k", "x_sum", "y_sum"] and [tuple(r) for r in wide.collect()] == [("a", 4, 2), ("b", None, None)]
    assert pivoted(df, ("k",), "n", ["x"], {"sum": F.sum("v"), "n": F.count("v")}).columns == ["k", "x_sum", "x_n"]
    assert sorted(map(tuple, melted(wide, ("k",), ("x_sum", "y_sum")).collect()), key=str) == [("a", "x_sum", 4), ("a", "y_sum", 2), ("b", "x_sum", None), ("b", "y_sum", None)]


def test_json_of_any_shape(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 2.5, "d": [1, 2]}'), (3, '{"b": {"c": "y", "e": true}}'), (4, "no json"), (5, None), (6, "[]"), (7, '{"a": null}')], "id int, j string").repartition(4)
    kind = inferred(df.where("id < 4 or id = 7"), "j")
    assert set(kind.names) == {"a", "b", "d"}
    got = {r["id"]: r.asDict() for r in shredded(df, "j", kind).collect()}
    assert float(got[1]["a"]) == 1 and float(got[2]["a"]) == 2.5 and got[1]["b.c"] == "x" and got[3]["b.e"] is True and got[2]["d"] == [1, 2]
    assert all(v is None for k, v in got[4].items() if k not in ("id", "j")) and all(got[5][c] is None for c in ("a", "b.c", "d")) and got[7]["a"] is None
    assert shredded(df.where("false"), "j").columns == ["id", "j", "j_json"] or shredded(df.where("false"), "j").count() == 0


SPEC = SkillSpec(
    "grade", "1", input_schema={"properties": {"score": {"type": "number"}, "name": {"type": "string"}}, "required": ["score"], "additionalProperties": False},
    output_schema={"properties": {"label": {"type": "string"}, "double": {"type": "number"}, "note": {"type": ["string", "null"]}}, "required": ["label", "note"]},
)


def test_skills_over_batches(spark):
    def grade(t: pa.Table) -> pa.Table:
        return pa.table({"label": pc.if_else(pc.greater(t["score"], 5), "high", "low"), "double": pc.multiply(t["score"], 2), "note": pc.if_else(pc.equal(t["score"], 1), None, "ok")})

    source = SkillSource(spark, "s", [(SPEC, None)], batches={"grade": grade})
    df = spark.createDataFrame([(i, float(i), "x") for i in range(10)], "id int, label double, output2 string").repartition(3)
    got = {r["id"]: r["output"].asDict() for r in source.apply_batches(df, SPEC.ref, score=F.col("label")).collect()}
    assert got[7] == {"label": "high", "double": 14.0, "note": "ok"} and got[1]["note"] is None and len(got) == 10
    assert source.apply_batches(df, SPEC.ref, score=F.col("label")).columns == [*df.columns, "output"]
    for bad in ({}, {"score": F.col("label"), "other": F.lit(1)}, {"score": F.col("output2")}):
        with pytest.raises(ExecutionError):
            source.apply_batches(df, SPEC.ref, **bad)
    with pytest.raises(Exception, match="nulls in"):
        source.apply_batches(df, SPEC.ref, score=F.when(F.col("id") > 3, F.col("label"))).collect()
    for wrong, said in ((lambda t: t.select(["score"]), "unknown properties"), (lambda t: pa.table({"double": t["score"]}), "lacks"), (lambda t: grade(t).slice(1), "a row for each"), (lambda t: pa.table({"label": ["x"] * len(t), "note": ["n"] * len(t), "double": ["text"] * len(t)}), "")):
        with pytest.raises(Exception, match=said):
            SkillSource(spark, "s", [(SPEC, None)], batches={"grade": wrong}).apply_batches(df, SPEC.ref, score=F.col("label")).collect()
    writes = SkillSpec("w", "1", output_schema={"properties": {}}, effect=EffectLevel.INTERNAL_WRITE)
    with pytest.raises(EffectPolicyError):
        SkillSource(spark, "s", [(writes, None)], batches={"w": grade}).apply_batches(df, writes.ref)
    assert SkillSource(spark, "s", [(SPEC, None)], batches={"grade": grade}).apply_batches(df.where("false"), SPEC.ref, score=F.col("label")).count() == 0
