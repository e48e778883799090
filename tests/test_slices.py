"""Slices in time order against a sort, and how often rows are exchanged for them."""

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators.ranges import with_slices
from sensorframe.operators.resample import Grid
from sensorframe.plans.export import write_slices
from test_ranks import max_rows


def slices_of(spark, path):
    rows = spark.read.parquet(str(path)).select("slice_id", "time", "v").collect()
    out = {}
    for r in rows:
        out.setdefault(int(r.slice_id), []).append((r.time, r.v))
    return out


@pytest.mark.parametrize("seed, span", [(1, 10**9), (2, 40), (3, 3), (4, 400)])
def test_slices_are_those_of_a_sort(spark, seed, span):
    rng = random.Random(seed)
    times = [None if rng.random() < 0.02 else at(rng.randrange(span) / 7) for _ in range(700)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "time timestamp_ntz, v int").repartition(5)
    for step in (1, 7, 64, 1_000):
        found = with_slices(df, "time", step).collect()
        assert sorted(r.v for r in found) == list(range(700))
        ordered = sorted(((r.time is not None, r.time, r.slice_id) for r in found), key=lambda r: (r[0], r[1] or at(0), r[2]))
        assert [r[2] for r in ordered] == [i // step for i in range(700)]


def test_equal_times_fill_slices(spark):
    df = spark.range(1_000).select(F.lit(at(5)).alias("time"), "id")
    counts = with_slices(df, "time", 300).groupBy("slice_id").count().collect()
    assert sorted((r["slice_id"], r["count"]) for r in counts) == [(0, 300), (1, 300), (2, 300), (3, 100)]
    assert with_slices(df.limit(0), "time", 300).count() == 0


def test_grid_slices(spark, tmp_path):
    grid = Grid.of(at(3), at(103))
    df = spark.createDataFrame([(at(3 + i), i) for i in reversed(range(100))], "time timestamp_ntz, v int")
    write_slices(df, str(tmp_path / "g"), 30, 4, grid=grid)
    write_slices(df, str(tmp_path / "n"), 30, 4)
    found = slices_of(spark, tmp_path / "g")
    assert found == slices_of(spark, tmp_path / "n")
    assert {k: [v for _, v in rows] for k, rows in found.items()} == {k: list(range(30 * k, min(30 * k + 30, 100))) for k in range(4)}
    files = [p for p in (tmp_path / "g").rglob("*.parquet")]
    assert len(files) == 4


def test_rows_are_exchanged_once(spark):
    df = spark.range(5_000).select((F.lit(at(0)) + F.make_dt_interval(secs=F.col("id"))).alias("time"), "id")
    sliced = with_slices(df, "time", 64).repartitionById(79, F.col("slice_id").cast("int"))
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange") - plan.count("Exchange hashpartitioning(_bucket") <= 1
    assert max_rows(sliced) <= 5_000
