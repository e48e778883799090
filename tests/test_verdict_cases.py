"""Cases outside the SQL checks: limits, lost rows, time text and zones, pruning."""

from datetime import datetime, timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.functions.cftime import compact_time, parse_bound, parse_datetime, time_text, unreadable_times, year_month
from sensorframe.operators import resample as resampling
from sensorframe.operators.ranges import range_ordered
from sensorframe.operators.raster import Bounds, rasterize
from sensorframe.operators.resample import Grid, align
from sensorframe.plans.cruise import clean_samples
from sensorframe.plans.fetch import fetch
from sensorframe.sources.streams import Stream, open_stream, write_stream

FORMS = {
    "7/1/16 10:00": datetime(2016, 7, 1, 10),
    "1-Jul-2016 10:00": datetime(2016, 7, 1, 10),
    "July 1, 2016": datetime(2016, 7, 1),
    "7/1/2016 3:00 PM": datetime(2016, 7, 1, 15),
    "7/1/2016 12:05 am": datetime(2016, 7, 1, 0, 5),
    "2016-07-01 10:00 AM": datetime(2016, 7, 1, 10),
    "1 Jul 2016 10:00": datetime(2016, 7, 1, 10),
    "20160701 10:00:00": datetime(2016, 7, 1, 10),
    "20160701T100000": datetime(2016, 7, 1, 10),
    "1/2/70": datetime(1970, 1, 2),
    "2016/7/1 1:02:03.5": datetime(2016, 7, 1, 1, 2, 3, 500_000),
    "2024-03-10 02:30:00": datetime(2024, 3, 10, 2, 30),
    "3/10/2024 2:30": datetime(2024, 3, 10, 2, 30),
}
WRONG = ["13/45/2016", "1 Foo 2016", "7/1/2016 15:00 PM", "not a time", "2016-13-01 10:00 AM"]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_time_text_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in [*FORMS, *WRONG]], "t string")
        found = {r.t: r.p for r in df.select("t", parse_datetime(F.col("t")).alias("p")).collect()}
        assert found == {**FORMS, **dict.fromkeys(WRONG)}
        times = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 0, 1500),)], "t timestamp_ntz")
        row = times.select(time_text(F.col("t")), compact_time(F.col("t")), year_month(F.col("t"))).first()
        assert tuple(row) == ("2024-03-10 02:30:00.001500", "20240310T023000", "2024-03")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bounds_read_the_same_forms(spark):
    assert {t: parse_bound(t) for t in FORMS} == FORMS
    for text in WRONG:
        with pytest.raises(ValueError):
            parse_bound(text)


def test_unreadable_times_are_reported(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "7/1/16"), (4, None), (5, " ")], "id int, start_time string")
    assert [tuple(r) for r in unreadable_times(df, ["start_time"]).collect()] == [("start_time", "x", 2)]


def test_unnamed_streams_take_no_part_at_any_width(series, monkeypatch):
    samples = series(a=[(0, 0), (4, 4)], b=[(0, 100), (4, 104)])
    found = []
    for widest in (64, 0):
        monkeypatch.setattr(resampling, "WIDEST_MERGE", widest)
        rows = align(samples, at(0), at(5), streams=["a"]).orderBy("time").collect()
        found.append([(r.time, r.v) for r in rows])
    assert found[0] == found[1] == [(at(i), float(i)) for i in range(5)]


def test_points_outside_given_bounds_lie_on_no_pixel(spark):
    points = spark.createDataFrame([(-1.0, 1.0), (0.0, 1.0), (9.9, 2.0), (10.0, 4.0), (11.0, 50.0)], "x double, y double")
    rows = rasterize(points, "x", "y", canvas=(10, 1), bounds=Bounds(0.0, 10.0, 0.0, 60.0)).collect()
    assert {(r.px, r.value, r.n) for r in rows} == {(0, 1.0, 1), (9, 3.0, 2)}


def test_strict_types_are_judged_by_file(spark):
    rows = [("c", "c1", "RS", "f1", "bad", "Slope Base"), ("c", "c1", "RS", "f1", "1", "Slope Base")]
    rows += [("c", "c1", "RS", "f2", "2", "Slope Base")]
    df = spark.createDataFrame(
        rows, "cruise string, cruise_id string, array_rd string, source_path string, ctd_pressure string, station string"
    )
    out = clean_samples(df, strict=True)
    assert "source_path" not in out.columns
    assert sorted((r.ctd_pressure for r in out.collect()), key=str) == [2.0, None, None]


def test_day_folders_are_pruned_and_hidden(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i // 24, i % 24), float(i), i) for i in range(24 * 10)]
    write_stream(spark.createDataFrame(rows, "time timestamp_ntz, v double, _pos bigint"), str(tmp_path), "s")
    stream = open_stream(spark, str(tmp_path), "s", time_ordered=True)
    cut = stream.select("inclusive", time=("2024-01-03T05:00:00", "2024-01-04T05:00:00"))
    assert cut.df.columns == ["time", "v", "_pos"] and cut.df.count() == 25
    plan = cut.df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "stream_day" in filters and ">=" in filters


def test_range_partitions_grow_in_number(spark):
    few = range_ordered(spark.range(1_000), ["id"], rows_per_partition=100)
    many = range_ordered(spark.range(10_000), ["id"], rows_per_partition=100)
    for df in (few, many):
        sizes = df.groupBy(F.shiftright("_place", 33)).count().agg(F.max("count")).first()[0]
        assert sizes <= 300


def test_tasks_follow_groups_and_ticks(spark):
    year = Grid.of("2024-01-01", "2025-01-01", timedelta(seconds=1))
    assert year.tasks(spark, 10_000) > 1_000 * year.tasks(spark, 1) // 4


def test_limits_apply_only_when_given(series):
    stream = Stream("a", series(a=[(i, i) for i in range(100)]).drop("stream"))
    request = {"ref": "a", "x": "time", "y": "v", "start_dt": "2024-01-01", "end_dt": "2024-01-01T00:01:00"}
    assert not fetch(request, {"a": stream}).shaded
    assert fetch(request, {"a": stream}, shade_threshold=10).shaded
    refused = fetch(request, {"a": stream}, max_dimension_bytes=100)
    assert refused.data is None and "too large" in refused.msg
    unknown = fetch({**request, "download": True, "download_format": "xls"}, {"a": stream}, "/nowhere")
    assert unknown.status == "failed" and "xls" in unknown.msg
