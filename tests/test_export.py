import json

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators.flatten import flatten_arrays
from sensorframe.plans.export import export, read_result, write_result
from sensorframe.plans.limits import MAX_FILES, plan_slices, slice_bounds

PLANS = [
    (1_000, 90_000_000, 1_112, 1, "file"),
    (1_000, 250_000_000, 400, 3, "folder"),
    (1_000, 5_100_000_000, 20, 50, "folder"),
    (1_000, 5_300_000_000, 19, 53, "refused"),
]


@pytest.mark.parametrize("rows,size,step,files,layout", PLANS)
def test_slice_plan(spark, rows, size, step, files, layout):
    planned = plan_slices(spark.createDataFrame([(rows, size)], "rows bigint, size bigint"), max_files=MAX_FILES)
    row = planned.first()
    assert (row["rows_per_slice"], row["n_files"], row["layout"]) == (step, files, layout)
    last = slice_bounds(planned).orderBy(F.desc("slice_id")).first()
    assert last["start_row"] < rows <= last["end_row"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1_000).select(
        F.timestamp_add("SECOND", F.pmod(F.col("id") * 37, F.lit(1000)), F.lit(at(0).isoformat()).cast("timestamp_ntz")).alias("time"),
        F.col("id").cast("double").alias("v"),
    )


def rows(df):
    return sorted(map(tuple, df.select("time", "v").collect()))


def test_slices_are_exact(spark, table, tmp_path):
    done = export(table, str(tmp_path), "2024-01-01", "2024-01-02", "", ["a", "b"], {"x": "time"}, part_bytes=4_000)
    data = spark.read.parquet(f"{done.path}/data")
    assert (done.n_files, done.n_rows, rows(data)) == (4, 1_000, rows(table))
    sizes = data.groupBy("slice_id").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"))
    parts = sizes.orderBy("slice_id").collect()
    assert [p["n"] for p in parts] == [250] * 4 and all(p["b"] < q["a"] for p, q in zip(parts, parts[1:]))
    files = [f for i in range(4) for f in (tmp_path / "20240101T000000_20240102T000000" / "data" / f"slice_id={i}").glob("*.parquet")]
    assert len(files) == 4
    (meta,) = (tmp_path / "20240101T000000_20240102T000000" / "meta").glob("part*.json")
    assert json.loads(meta.read_text())["reference_designators"] == ["a", "b"]


def test_single_slice(spark, table, tmp_path):
    done = export(table, str(tmp_path), "2024-01-01", "2024-01-02")
    assert done.n_files == 1 and rows(spark.read.parquet(f"{done.path}/data")) == rows(table)


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_parts(spark, table, tmp_path, kind):
    done = export(table, str(tmp_path), "2024-01-01", "2024-01-02", kind, part_bytes=4_000)
    read = spark.read.schema(table.schema).option("header", True)
    assert done.n_files == 4
    assert rows(getattr(read, kind)(f"{done.path}/data")) == rows(table)
    parts = sorted((tmp_path / "20240101T000000_20240102T000000" / "data").glob(f"part*.{kind}"))
    times = [[r["time"] for r in getattr(read, kind)(str(p)).collect()] for p in parts]
    assert len(parts) == 4 and sum(times, []) == sorted(sum(times, []))


def test_too_many_parts(table, tmp_path):
    for kind, word in (("csv", "CSV"), ("netcdf", "NetCDF")):
        done = export(table, str(tmp_path), "2024-01-01", "2024-01-02", kind, part_bytes=100, max_files=MAX_FILES)
        assert done.path is None and f"too large for {word} data format" in done.msg
    assert not list(tmp_path.iterdir())


def test_unknown_format_and_empty_table(table, tmp_path):
    done = export(table, str(tmp_path), "2024-01-01", "2024-01-02", "netcdf4")
    assert done.path is None and done.status == "failed" and "netcdf4" in done.msg
    done = export(table.where("v < 0"), str(tmp_path), "2024-01-01", "2024-01-02", "csv")
    assert done.path is None and done.msg.startswith("No data found")


def test_arrays_are_flattened_for_csv(spark, tmp_path):
    df = spark.createDataFrame([(at(0), [1.0, 2.0]), (at(1), [3.0])], "time timestamp_ntz, s array<double>")
    done = export(df, str(tmp_path), "2024-01-01", "2024-01-02", "csv")
    back = spark.read.option("header", True).csv(f"{done.path}/data")
    assert back.columns == ["time", "index", "s"] and done.n_rows == 3
    two = flatten_arrays(df.withColumn("t", F.transform("s", lambda x: -x)))
    assert sorted((r["s"], r["t"], r["index"]) for r in two.collect()) == [(1.0, -1.0, 0), (2.0, -2.0, 1), (3.0, -3.0, 0)]


def test_results_by_request(spark, table, tmp_path):
    path = str(tmp_path / "results")
    write_result(table.where("v < 10"), path, "a")
    write_result(table.where("v >= 10"), path, "b")
    write_result(table.where("v < 5"), path, "a")
    write_result(table.select("time", (F.col("v") * 2).alias("other")), path, "c")
    assert read_result(spark, path, "a").columns == table.columns
    assert read_result(spark, path, "c").columns == ["time", "other"]
    assert read_result(spark, path, "c").where("other is null").isEmpty()
    assert read_result(spark, path, "a").count() == 5 and read_result(spark, path, "b").count() == 990


def test_no_limit_unless_asked_for(table, tmp_path):
    done = export(table, str(tmp_path), "2024-01-01", "2024-01-02", "netcdf", part_bytes=100)
    assert done.n_files > 50 and done.n_rows == 1000


def test_reported_files_are_those_written(spark, tmp_path):
    same = spark.createDataFrame([(at(0), float(i % 2)) for i in range(200)], "time timestamp_ntz, v double")
    for kind in ("csv", "netcdf"):
        done = export(same, str(tmp_path / kind), "2024-01-01", "2024-01-02", kind, part_bytes=200)
        found = [p for p in (tmp_path / kind).rglob("data/**/part-*") if p.is_file()]
        assert done.n_files == len(found)
        assert spark.read.json(f"{done.path}/meta").first()["n_files"] == len(found)


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    from sensorframe.sources.samples import read_headers, read_text_csv

    texts = ['he said "x", then y', "two\nlines", "a,b", '"', "plain"]
    df = spark.createDataFrame([(at(i), t) for i, t in enumerate(texts)], "time timestamp_ntz, `a \"q\", b` string")
    done = export(df, str(tmp_path), "2024-01-01", "2024-01-02", "csv")
    files = [str(p) for p in tmp_path.rglob("part-*.csv")]
    read = read_text_csv(spark, f"{done.path}/data", ["time", "note"])
    assert sorted(r["note"] for r in read.collect()) == sorted(texts)
    assert {r["header"] for r in read_headers(spark, files).collect()} == {"time", 'a "q", b'}


def test_flatten_keeps_rows_without_elements(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], [5]), (2, None, [6, 7]), (3, [], None), (4, None, None)], "id int, a array<double>, b array<int>"
    )
    zipped = sorted(map(tuple, flatten_arrays(df).collect()), key=str)
    assert zipped == sorted(
        [(1, 0, 1.0, 5), (1, 1, 2.0, None), (2, 0, None, 6), (2, 1, None, 7), (3, None, None, None), (4, None, None, None)],
        key=str,
    )
    crossed = flatten_arrays(df, dims={"a": "depth", "b": "wave"})
    assert crossed.columns == ["id", "depth", "wave", "a", "b"]
    assert sorted((r.depth, r.wave, r.a, r.b) for r in crossed.where("id = 1").collect()) == [(0, 0, 1.0, 5), (1, 0, 2.0, 5)]
    assert [(r.depth, r.wave, r.b) for r in crossed.where("id = 2").orderBy("wave").collect()] == [(None, 0, 6), (None, 1, 7)]
    assert crossed.where("id > 2").count() == 2
