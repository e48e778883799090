"""Counts of ranges against a scan of all rows, and their plan."""

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators import joins
from sensorframe.operators.ranks import COARSE, FINE, range_counts
from sensorframe.plans.requests import selected_rows


def brute(ranges, rows):
    out = []
    for key, low, high in ranges:
        hit = [v for k, a, v in rows if k == key and a is not None and None not in (low, high) and low <= a < high]
        out.append((key, low, high, len(hit), min(hit, default=None), max(hit, default=None)))
    return sorted(out, key=str)


def some(rng, n):
    """Values that share fine cells, coarse cells, or nothing; negative ones too."""
    base = [rng.randrange(-3, 4) * (1 << COARSE) + rng.randrange(3) * (1 << FINE) for _ in range(6)]
    return [rng.choice(base) + rng.randrange(5) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_and_extremes(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr("sensorframe.operators.ranks.fits_broadcast", lambda small: False)
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), v, rng.randrange(-50, 50)) for v in some(rng, 300)] + [("a", None, 7)]
    bounds = some(rng, 60)
    ranges = [(rng.choice("abc"), *rng.choice([sorted(p), p])) for p in zip(bounds[::2], bounds[1::2])]
    ranges += [("a", None, 3), ("a", 3, None), ("a", 5, 5), ranges[0], ("b", -(1 << 50), 1 << 50)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    asked = spark.createDataFrame(ranges, "k string, low bigint, high bigint")
    found = range_counts(asked, df, ["k"], F.col("at"), "low", "high", F.col("v")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(ranges, rows)
    plain = range_counts(asked, df, ["k"], F.col("at"), "low", "high").collect()
    assert sorted(((r.k, r.low, r.high, r.n) for r in plain), key=str) == [r[:4] for r in brute(ranges, rows)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, at bigint, v bigint")
    asked = spark.createDataFrame([("a", 1, 2)], "k string, low bigint, high bigint")
    assert range_counts(asked, df, ["k"], F.col("at"), "low", "high", F.col("v")).first().n == 0
    assert range_counts(asked.limit(0), df, ["k"], F.col("at"), "low", "high").count() == 0


def test_rows_never_meet_the_ranges_that_hold_them(spark):
    """A thousand ranges that all hold all rows: no operator makes more rows than rows and ranges together."""
    rows = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 50_000).alias("at"))
    asked = spark.range(1_000).select(F.lit("a").alias("k"), (-F.col("id")).alias("low"), (F.col("id") + 10**12).alias("high"))
    df = range_counts(asked, rows, ["k"], F.col("at"), "low", "high")
    assert df.where("n = 20000").count() == 1_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    most = max_rows(df)
    assert most <= 20_000 + 2 * 1_000


def max_rows(df):
    """The most rows any operator of the executed plan gave."""
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    df.collect()
    seen, todo = 0, [query.executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            seen = max(seen, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        for inner in ("executedPlan", "plan"):
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",) and inner == "executedPlan":
                todo.append(node.executedPlan())
            if node.getClass().getSimpleName().endswith("QueryStageExec") and inner == "plan":
                todo.append(node.plan())
    return seen


def test_unordered_positions(spark, series):
    """Rows between the first and last match stay, whatever their time."""
    samples = series(A=[(0, 0), (50, 1), (10, 2), (60, 3), (20, 4), (30, 5)])
    asked = spark.createDataFrame([("r", "A", at(10), at(30))], "request_id string, stream string, start timestamp_ntz, end timestamp_ntz")
    assert tuple(selected_rows(asked, samples).first()) == ("r", "A", 3, 3)
    assert tuple(selected_rows(asked, samples, time_ordered=True).first()) == ("r", "A", 3, 2)
    assert joins.BROADCAST_ROWS > 0
