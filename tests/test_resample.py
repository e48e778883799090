import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import at, seconds
from pyspark.sql import functions as F

from sensorframe.operators import resample as module
from test_ranks import max_rows

from sensorframe.operators.resample import Grid, align, grid_ticks, resample

A = [(0, 0), (10, 10), (20, 20), (30, 30)]
B = [(0, 0), (10, None), (20, 20)]


def second(n):
    return timedelta(seconds=n)


def values(df, name="v"):
    return {seconds(r["time"]): r[name] for r in df.collect()}


def brute(points, start, end, step, max_gap=None):
    """Linear then nearest fill with NumPy, one value per tick."""
    ticks = np.arange(start, end, step, dtype="float64")
    t = np.array([p[0] for p in points], dtype="float64")
    v = np.array([np.nan if p[1] is None else p[1] for p in points], dtype="float64")
    order = np.argsort(t)
    t, v = t[order], v[order]
    out = np.full(len(ticks), np.nan)
    for i, x in enumerate(ticks):
        j = np.searchsorted(t, x, side="right") - 1
        if j >= 0 and t[j] == x:
            out[i] = v[j]
        elif 0 <= j < len(t) - 1:
            out[i] = v[j] + (v[j + 1] - v[j]) / (t[j + 1] - t[j]) * (x - t[j])
    if max_gap is None or len(ticks) == 0:
        return ticks, out
    good = np.flatnonzero(~np.isnan(out))
    filled = out.copy()
    for i in np.flatnonzero(np.isnan(out)):
        before, after = good[good < i], good[good > i]
        p = before[-1] if len(before) else None
        q = after[0] if len(after) else None
        if p is None and q is None:
            continue
        length = (q if q is not None else len(ticks) - 1) - (p if p is not None else 0)
        if length * step > max_gap:
            continue
        if p is None or (q is not None and i - p > q - i):
            filled[i] = out[q]
        else:
            filled[i] = out[p]
    return ticks, filled


def check(df, points, start, end, step, max_gap=None, name="v"):
    found = values(df, name)
    ticks, expected = brute(points, start, end, step, max_gap)
    assert sorted(found) == pytest.approx(list(ticks))
    for tick, value in zip(ticks, expected):
        got = found[min(found, key=lambda k: abs(k - tick))]
        assert (got is None) == bool(np.isnan(value)), (tick, got, value)
        if got is not None:
            assert got == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_ramp(series):
    found = values(resample(series(A=A), at(0), at(33), position="_pos"))
    assert [found[i] for i in range(31)] == pytest.approx(list(range(31)))
    assert found[31] is None and found[32] is None


@pytest.mark.parametrize("start,end,gap,expected", [
    (0, 33, 86_400, {31: 30, 32: 30}),
    (0, 33, 1, {31: None, 32: None}),
    (0, 33, 2, {31: 30, 32: 30}),
    (-5, 3, 86_400, {-5: 0, -1: 0, 0: 0}),
    (-5, 3, 4, {-5: None, -1: None, 0: 0}),
])
def test_edges(series, start, end, gap, expected):
    found = values(resample(series(A=A), at(start), at(end), max_gap=second(gap), position="_pos"))
    assert {k: found[k] for k in expected} == expected


def test_null_sample(series):
    linear = values(resample(series(B=B), at(0), at(21), position="_pos"))
    assert all(linear[i] is None for i in range(1, 20)) and linear[0] == 0 and linear[20] == 20
    filled = values(resample(series(B=B), at(0), at(21), max_gap=second(86_400), position="_pos"))
    assert [filled[i] for i in range(21)] == [0] * 11 + [20] * 10


def test_empty_and_fractional_grids(spark, series):
    assert resample(series(A=A), at(5), at(5), position="_pos").count() == 0
    assert align(series(A=A), at(9), at(5), position="_pos").count() == 0
    assert [seconds(r["time"]) for r in grid_ticks(spark, at(0.5), at(3.5)).collect()] == [0.5, 1.5, 2.5]
    assert [seconds(r["time"]) for r in grid_ticks(spark, at(0), at(2.5)).collect()] == [0, 1, 2]
    found = values(resample(series(A=A), at(0.5), at(3), position="_pos"))
    assert found == pytest.approx({0.5: 0.5, 1.5: 1.5, 2.5: 2.5})


@pytest.mark.parametrize("seed", range(6))
def test_random_series(series, monkeypatch, seed):
    """Several streams with gaps, nulls, dense bursts and odd fractions; tiny buckets."""
    monkeypatch.setattr(module, "MIN_BUCKET_TICKS", 5)
    monkeypatch.setattr(module, "HOME_TICKS", 7 if seed % 2 else 10_000)
    rnd = random.Random(seed)
    step = rnd.choice([1, 2, 7])
    start, end = rnd.choice([(0, 300), (-40.5, 250), (20, 180.25)])
    gap = rnd.choice([3, 20, 86_400])
    streams = {}
    for name in "abc":
        times = set()
        while len(times) < rnd.choice([1, 2, 40]):
            base = rnd.uniform(-60, 330)
            times.add(round(base) if rnd.random() < 0.5 else round(base, 3))
            if rnd.random() < 0.3:
                times.update(round(base + i / 50, 3) for i in range(10))
        streams[name] = [(t, None if rnd.random() < 0.3 else rnd.uniform(-5, 5)) for t in sorted(times)]
    df = series(**streams)
    linear = resample(df, at(start), at(end), second(step), position="_pos").cache()
    filled = resample(df, at(start), at(end), second(step), max_gap=second(gap), position="_pos").cache()
    for name, points in streams.items():
        check(linear.where(F.col("stream") == name), points, start, end, step)
        check(filled.where(F.col("stream") == name), points, start, end, step, gap)
    merged = align(df, at(start), at(end), second(step), max_gap=second(gap), position="_pos", streams="abc", suffix=True).cache()
    for name, points in streams.items():
        check(merged, points, start, end, step, gap, f"v_{name}")
    monkeypatch.setattr(module, "WIDEST_MERGE", 0)
    again = align(df, at(start), at(end), second(step), max_gap=second(gap), position="_pos", streams="abc", suffix=True)
    rounded = [F.round(c, 9).alias(c) if c != "time" else F.col(c) for c in merged.columns]
    assert sorted(map(str, again.select(rounded).collect())) == sorted(map(str, merged.select(rounded).collect()))


def test_hot_cell(spark):
    """A third of all samples lies within one second; only its edges matter."""
    burst = spark.range(200_000).select(
        F.timestamp_add("MICROSECOND", F.col("id") + 50_000_000, F.lit("2024-01-01").cast("timestamp_ntz")).alias("time"),
        F.col("id").cast("double").alias("v"),
    )
    ends = spark.createDataFrame([(at(0), 0.0), (at(100), 500.0)], "time timestamp_ntz, v double")
    df = burst.unionByName(ends).withColumn("stream", F.lit("a"))
    found = values(resample(df, at(0), at(100), duplicates="unique"))
    assert found[50] == 0.0
    last = 50 + 199_999 / 1e6
    assert found[51] == pytest.approx(199_999 + (500 - 199_999) * (51 - last) / (100 - last))


def test_long_gap_crosses_many_buckets(series):
    year = 365 * 86_400
    df = series(a=[(0, 0), (year, 365)])
    days = values(resample(df, at(0), at(year + 1), timedelta(days=1), position="_pos"))
    assert days[86_400 * 100] == pytest.approx(100)
    minutes = resample(df, at(0), at(year + 60), timedelta(minutes=1), position="_pos")
    row = minutes.agg(F.count("v").alias("n"), F.max("v").alias("top"), F.sum("v").alias("sum")).first()
    assert row["n"] == 365 * 1440 + 1 and row["top"] == 365 and row["sum"] == pytest.approx(365 / 2 * (365 * 1440 + 1))


def test_duplicates(series):
    df = series(a=[(0, 1), (0, 2), (10, 3)])
    with pytest.raises(Exception, match="several samples at one time"):
        resample(df, at(0), at(5), position="_pos").collect()
    assert values(resample(df, at(0), at(1), duplicates="first", position="_pos")) == {0: 1}
    with pytest.raises(ValueError, match="needs a position"):
        resample(df, at(0), at(1), duplicates="first")


def test_conflict_and_equal_values(series):
    same = series(a=[(0, 1), (10, 1)], b=[(0, 1), (10, 1)])
    assert set(values(align(same, at(0), at(5), position="_pos")).values()) == {1}
    differ = series(a=[(0, 1), (10, 1)], b=[(0, 2), (10, 2)])
    for names in ((), ("a", "b")):
        assert set(values(align(same, at(0), at(5), position="_pos", streams=names)).values()) == {1}
        with pytest.raises(Exception, match="conflicting values for 'v'"):
            align(differ, at(0), at(5), position="_pos", streams=names).collect()
    with pytest.raises(ValueError, match="names of the streams"):
        align(differ, at(0), at(5), position="_pos", suffix=True)


def test_other_columns(spark):
    df = spark.createDataFrame(
        [("a", at(0), "x", 1), ("a", at(10), "y", 2)], "stream string, time timestamp_ntz, kind string, n int"
    )
    assert resample(df, at(0), at(2), duplicates="unique").columns == ["stream", "time", "n"]
    found = values(resample(df, at(-2), at(13), duplicates="unique", categorical="previous"), "kind")
    assert [found[i] for i in (-2, -1, 0, 9, 10, 12)] == [None, None, "x", "x", "y", "y"]


def test_grid_sizes_stay_bounded():
    grid = Grid.of("2014-01-01", "2024-01-01", timedelta(milliseconds=1))
    assert grid.bucket_ticks**2 <= grid.ticks and grid.buckets <= grid.bucket_ticks + 3


def test_one_scan_and_no_shuffle_of_ticks(spark, sf_dir):
    from sensorframe.queries.bindings import END, START, event_streams

    rows = event_streams(spark, sf_dir).drop("_pos", "user_id")
    df = align(rows, START, END, duplicates="unique", streams=["click", "view"], suffix=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    above = plan[: plan.index("explode(sequence(_lo")]
    assert "Exchange" not in above and "Aggregate" not in above and "Sort" not in above
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "IsNotNull(ts)" in pushed and "In(event_type, [click,view])" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_duplicates_are_found_in_any_cell(series):
    crowd = [(5 + i / 100, i) for i in range(90)]
    for extra in ([(5.25, 0)], [(40, 1), (40, 2)], [(-9, 1), (-9.5, 2), (-9, 3)], [(300, 1), (300, 1)]):
        with pytest.raises(ValueError, match="several samples at one time"):
            resample(series(A=crowd + extra, B=[(1, 1)]), at(0), at(100))
    # The same instant in two streams is no duplicate, nor are close ones.
    found = resample(series(A=crowd, B=crowd), at(5), at(7)).where("stream = 'A'").collect()
    assert len(found) == 2


def test_samples_are_not_exchanged(spark, series):
    """What the grid is made from has one row for a cell, whatever the number of samples."""
    df = resample(series(A=[(i / 50, i) for i in range(5_000)]), at(0), at(100))
    assert max_rows(df) <= 3 * 101
