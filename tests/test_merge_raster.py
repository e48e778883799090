import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators.merge import merge_conflicts, merge_on, suffix_variables, union_by_name
from sensorframe.operators.raster import Bounds, rasterize


def frame(spark, name, *points):
    return spark.createDataFrame([(at(t), v) for t, v in points], f"time timestamp_ntz, {name} double")


def test_coalesce(spark):
    merged = merge_on([frame(spark, "a", (1, 1.0), (2, 5.0)), frame(spark, "a", (1, None), (2, 5.0)), frame(spark, "b", (3, 7.0))])
    assert sorted((r["time"], r["a"], r["b"]) for r in merged.collect() if r["a"]) == [(at(1), 1.0, None), (at(2), 5.0, None)]
    assert merged.where("b = 7").count() == 1 and merged.count() == 3


def test_conflict(spark):
    frames = [frame(spark, "a", (1, 1.0), (2, 3.0)), frame(spark, "a", (1, 2.0), (2, 3.0))]
    with pytest.raises(Exception, match="conflicting values for 'a'"):
        merge_on(frames).collect()
    assert [tuple(r) for r in merge_conflicts(frames).collect()] == [(at(1), "a", "1.0", "2.0")]
    named = merge_on(suffix_variables(dict(zip("xy", frames))))
    assert sorted(named.columns) == ["a_x", "a_y", "time"]


def test_union_by_name(spark):
    rows = union_by_name([frame(spark, "a", (1, 1.0)), frame(spark, "b", (2, 2.0))])
    assert rows.columns == ["time", "a", "b"] and rows.where("b IS NULL").count() == 1


def test_raster_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-3, 8, 5000), rng.normal(size=5000)
    df = spark.createDataFrame([(float(a), float(b), float(a * b)) for a, b in zip(x, y)], "x double, y double, c double")
    cells = {(r["px"], r["py"]): r for r in rasterize(df, "x", "y", "c", (37, 21)).collect()}
    px = np.minimum(np.floor((x - x.min()) * 37 / (x.max() - x.min())), 36).astype(int)
    py = np.minimum(np.floor((y - y.min()) * 21 / (y.max() - y.min())), 20).astype(int)
    assert sum(r["n"] for r in cells.values()) == 5000
    for key, row in cells.items():
        here = (px == key[0]) & (py == key[1])
        assert here.sum() == row["n"] and np.mean((x * y)[here]) == pytest.approx(row["value"])
    given = Bounds(x.min(), x.max(), y.min(), y.max())
    assert rasterize(df, "x", "y", "c", (37, 21), Bounds(*map(float, vars(given).values()))).count() == len(cells)


def test_raster_nulls_and_flat_axis(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, None), (None, 2.0), (1.0, 9.0)], "x double, y double")
    rows = rasterize(df, "x", "y", canvas=(4, 2)).collect()
    assert {(r["px"], r["py"], r["value"], r["n"]) for r in rows} == {(0, 0, 5.0, 1), (0, 1, 9.0, 1)}


def test_dense_raster(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (3.0, 3.0, 2.0)], "x double, y double, c double")
    rows = rasterize(df, "x", "y", "c", canvas=(3, 2), dense=True)
    assert rows.count() == 6 and rows.where(F.col("value").isNull()).count() == 4


def test_raster_partial_aggregation(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = rasterize(df, "ts", "value")._jdf.queryExecution().toString()
    assert "partial_avg" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
