"""Records of stored streams, and requests that are decided on them."""

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.functions.values import readable_size
from sensorframe.operators.select import covers, spans_meet
from sensorframe.plans.fetch import dimension_size, fetch, prepare, uncovered_streams
from sensorframe.sources.statistics import order_of, read_statistics
from sensorframe.sources.streams import open_stream, recorded_manifest, write_stream

KIND = "time timestamp_ntz, v double, note string, w array<float>, _pos bigint"


def stored(spark, root, rows, name="s", **options):
    write_stream(spark.createDataFrame(rows, KIND), str(root), name, **options)
    return open_stream(spark, str(root), name)


def row(second, pos, v=1.0, note="ab", w=(1.0, 2.0)):
    return (at(second), v, note, w and list(w), pos)


def test_record_of_a_stream(spark, tmp_path):
    s = stored(spark, tmp_path, [row(0, 0), row(90_000, 1, float("nan"), None, None), row(5, 2, None, "äb", ())])
    known = s.statistics
    assert (known.rows, known.first_time, known.last_time) == (3, at(0), at(90_000))
    assert {v.variable: (v.n_present, v.n_values, v.n_bytes) for v in known.variables} == {
        "time": (3, 3, 24),
        "v": (1, 3, 24),
        "note": (2, 3, 5),
        "w": (2, 2, 8),
        "_pos": (3, 3, 24),
    }
    assert known.unique and not known.ordered and not s.time_ordered
    assert s.df.columns == ["time", "v", "note", "w", "_pos"] and s.df.count() == 3
    found = {r.variable: r for r in recorded_manifest(spark, {"s": s}).collect()}
    assert found["w"].dims == ["time", "w_index"] and found["w"].item_bytes == 4 and "_pos" not in found
    assert dimension_size({"s": s}).text == "24.0 bytes"


@pytest.mark.parametrize(
    "samples, expected",
    [
        ([], (True, True)),
        ([(0, 0), (1, 1), (4_000, 2)], (True, True)),
        ([(0, 0), (0, 1), (4_000, 2)], (True, False)),
        ([(0, 5), (4_000, 3)], (False, True)),
        ([(0, 1), (0, 7), (1, 6)], (False, False)),
        ([(0, 1), (9_000, 9), (8_999, 10)], (False, True)),
        ([(None, 9), (1, 0)], (True, True)),
    ],
)
def test_order_is_exact(spark, samples, expected):
    rows = [(None if t is None else at(t), p) for t, p in samples]
    df = spark.createDataFrame(rows, "time timestamp_ntz, _pos bigint")
    assert order_of(df, "time", "_pos") == expected
    assert order_of(df, "time", None) == (True, expected[1])


def test_streams_without_a_record(spark, tmp_path):
    s = stored(spark, tmp_path, [row(i, i) for i in range(4)], statistics=False)
    assert s.statistics is None and not s.time_ordered and read_statistics(spark, str(tmp_path / "none")) is None
    assert dimension_size({"s": s}).size == 32 and uncovered_streams({"s": s}, at(1), at(2)) == []
    with pytest.raises(ValueError, match="without statistics"):
        recorded_manifest(spark, {"s": s})
    # Writing again without one leaves no stale record.
    assert stored(spark, tmp_path, [row(0, 0)]).statistics.rows == 1
    assert stored(spark, tmp_path, [row(0, 0)] * 2, statistics=False).statistics is None


def test_size_and_coverage_start_no_job(spark, tmp_path):
    s = stored(spark, tmp_path, [row(i, i) for i in range(100)])
    spark.sparkContext.setJobGroup("record", "")
    assert uncovered_streams({"s": s}, at(1), at(2)) == [] and dimension_size({"s": s}).size == 800
    refused = prepare({"s": s}, "time", "v", "2024-01-01T00:00:05", "2024-01-01T00:00:50", max_dimension_bytes=799)
    assert refused.merged is None and "800.0 bytes" in refused.msg
    ready = prepare({"s": s}, "time", "v", "2024-01-01T00:00:05", "2024-01-01T00:00:50", max_dimension_bytes=800)
    outside = prepare({"s": s}, "time", "v", "2023-01-01", "2023-01-02")
    assert outside.merged is None and ready.merged is not None
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("record")
    spark.sparkContext.setJobGroup("tests", "")
    assert ready.merged.count() == 45


def test_empty_results_still_say_why(spark, tmp_path):
    s = stored(spark, tmp_path, [row(i * 10, i) for i in range(4)])
    base = {"ref": "s", "x": "time", "y": "v"}
    gap = fetch({**base, "start_dt": at(12).isoformat(), "end_dt": at(18).isoformat()}, {"s": s})
    assert gap.status == "failed" and "No sample of s" in gap.msg
    cut = fetch({**base, "start_dt": at(0).isoformat(), "end_dt": at(5).isoformat()}, {"s": s})
    assert (cut.status, cut.count) == ("completed", 0) and cut.msg == "Empty data stream(s) found: s."
    away = fetch({**base, "start_dt": at(-90).isoformat(), "end_dt": at(-9).isoformat()}, {"s": s})
    assert away.status == "completed" and away.count == 0


def test_spans_meet_as_covers_does(spark):
    times = [None, *(at(t) for t in (0, 5, 9, 10, 12))]
    rows = [(a, b) for a in times[1:] for b in times[1:]]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    for mode in ("reference", "overlap"):
        for first, last in ((at(5), at(10)), (at(5), at(5)), (None, None)):
            bounds = [F.lit(t).cast("timestamp_ntz") for t in (first, last)]
            found = df.select("a", "b", covers(F.col("a"), F.col("b"), *bounds, mode).alias("c")).collect()
            assert all(r.c == spans_meet(r.a, r.b, first, last, mode) for r in found)


def test_readable_size(spark):
    from sensorframe.functions.values import size_text

    sizes = [0, 1, 1023, 1024, 1536, 10**6, 10**9, 5 * 1024**4]
    found = spark.createDataFrame([(i,) for i in sizes], "n bigint").select("n", size_text(F.col("n")).alias("t")).collect()
    assert all(readable_size(r.n) == r.t for r in found)
