import random
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators.asof import asof_join
from sensorframe.operators.joins import fits_broadcast, sized_join
from sensorframe.operators.ranges import bucket_of, range_ordered, row_index, row_slices


def test_row_index_with_a_third_of_identical_rows(spark):
    df = spark.range(9_000).select(F.when(F.col("id") < 3_000, F.lit(7)).otherwise(F.col("id") % 13).alias("k"))
    rows = row_index(df, ["k"]).collect()
    assert sorted(r["row_index"] for r in rows) == list(range(9_000))
    ordered = sorted(rows, key=lambda r: r["row_index"])
    assert all(a["k"] <= b["k"] for a, b in zip(ordered, ordered[1:]))


def test_identical_rows_are_split(spark):
    placed = range_ordered(spark.range(8_000).select(F.lit(1).alias("k")), ["k"])
    sizes = [r["count"] for r in placed.groupBy(bucket_of("_place")).count().collect()]
    assert max(sizes) < 3_000 and sum(sizes) == 8_000


def test_empty_table(spark):
    assert row_index(spark.range(0).toDF("k"), ["k"]).collect() == []


def test_slices(spark):
    rows = row_slices(spark.range(10).toDF("k"), ["k"], 4).collect()
    assert {(r["k"], r["slice_id"]) for r in rows} == {(k, k // 4) for k in range(10)}


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("seed", range(3))
def test_asof_against_brute_force(spark, direction, seed):
    rnd = random.Random(seed)
    # Half of the rows carry one key and one instant.
    left = [("a" if i % 2 else rnd.choice("abc"), 50 if i % 2 else rnd.randint(0, 100), i) for i in range(400)]
    right = {(rnd.choice("ab"), rnd.randint(0, 100)) for _ in range(60)}
    ldf = spark.createDataFrame([(k, at(t), i) for k, t, i in left], "k string, t timestamp_ntz, i int")
    rdf = spark.createDataFrame([(k, at(t), t) for k, t in right], "k string, s timestamp_ntz, v int")
    got = {r["i"]: r["v"] for r in asof_join(ldf, rdf, "t", "s", ["v"], ["k"], direction).collect()}
    for k, t, i in left:
        times = sorted(s for key, s in right if key == k)
        before = [s for s in times if s <= t]
        after = [s for s in times if s >= t]
        if direction == "backward":
            expected = before[-1] if before else None
        elif direction == "forward":
            expected = after[0] if after else None
        else:
            expected = min(times, key=lambda s: (abs(s - t), s)) if times else None
        assert got[i] == expected
    assert len(got) == len(left)


def test_asof_tolerance_and_missing_times(spark):
    left = spark.createDataFrame([(1, at(10)), (2, at(99)), (3, None)], "i int, t timestamp_ntz")
    right = spark.createDataFrame([(at(8), 5)], "s timestamp_ntz, v int")
    rows = asof_join(left, right, "t", "s", ["v"], tolerance=timedelta(seconds=5)).collect()
    assert {r["i"]: r["v"] for r in rows} == {1: 5, 2: None, 3: None}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast(spark, how):
    big = spark.range(2_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k bigint, s string")
    fast = sized_join(big, small, ["k"], how, fits=True).select("k", "n", "s")
    salted = sized_join(big, small, ["k"], how, fits=False).select("k", "n", "s")
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)


def test_broadcast_bounds(spark):
    assert fits_broadcast(spark.range(100))
    assert not fits_broadcast(spark.range(100), max_rows=99)
    wide = spark.range(10).select(F.expr("repeat('x', 1000)").alias("s"))
    assert not fits_broadcast(wide, max_bytes=5_000)
