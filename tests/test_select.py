import pytest
from conftest import at, seconds
from pyspark.sql import functions as F

from sensorframe.operators.select import axis_columns, covers, project, select_ranges, select_time, swap_key
from sensorframe.plans.fetch import download_request, fetch, plot_request
from sensorframe.plans.plot import PlotResult, column_lists, list_pages
from sensorframe.sources.streams import Stream, build_manifest, describe_stream, open_stream, write_stream

A = [(0, 0), (10, 10), (20, 20), (30, 30)]


def text(second):
    return at(second).isoformat()


# start, end, covered by reference, by overlap, inclusive rows, reference rows, outcome
CASES = [
    (5, 25, True, True, [10, 20], [10], "points"),
    (-10, 40, False, True, [0, 10, 20, 30], [0, 10, 20], "uncovered"),
    (-10, 30, False, True, [0, 10, 20, 30], [0, 10, 20], "uncovered"),
    (0, 5, True, True, [0], [], "empty"),
    (12, 18, True, True, [], [], "failed"),
    (30, 40, False, True, [30], [], "uncovered"),
    (25, 5, True, False, [], [], "failed"),
]


@pytest.fixture(scope="module")
def stream(series):
    return Stream("A", series(A=A).drop("stream"))


@pytest.mark.parametrize("start,end,reference,overlap,inclusive,cut,outcome", CASES)
@pytest.mark.parametrize("ordered", [False, True])
def test_time_select(stream, start, end, reference, overlap, inclusive, cut, outcome, ordered):
    rows = select_time(stream.df, at(start), at(end), ordered=ordered).collect()
    assert sorted(seconds(r["time"]) for r in rows) == cut
    rows = select_time(stream.df, at(start), at(end), "inclusive").collect()
    assert sorted(seconds(r["time"]) for r in rows) == inclusive


@pytest.mark.parametrize("start,end,reference,overlap,inclusive,cut,outcome", CASES)
def test_coverage(spark, start, end, reference, overlap, inclusive, cut, outcome):
    row = spark.createDataFrame([(at(start), at(end), at(0), at(30))], "s timestamp_ntz, e timestamp_ntz, a timestamp_ntz, b timestamp_ntz")
    c = [F.col(x) for x in "seab"]
    found = row.select(covers(*c, "reference"), covers(*c, "overlap")).first()
    assert tuple(found) == (reference, overlap)


@pytest.mark.parametrize("start,end,reference,overlap,inclusive,cut,outcome", CASES)
def test_plot_request(stream, start, end, reference, overlap, inclusive, cut, outcome):
    result = plot_request({"A": stream}, "time", "v", at(start).isoformat(), at(end).isoformat())
    if outcome == "points":
        assert result.count == len(cut) and [r["v"] for r in result.data.collect()] == cut
    else:
        words = {"uncovered": "does not contain data", "empty": "Empty data stream(s) found: A", "failed": "No sample of A"}
        assert result.data is None and words[outcome] in result.msg
        assert result.status == ("failed" if outcome == "failed" else "completed")


def test_unordered_rows_between_matches_stay(series):
    df = series(A=[(0, 0), (50, 1), (5, 2), (60, 3), (7, 4), (8, 5)])
    assert sorted(r["v"] for r in select_time(df, at(5), at(8)).collect()) == [2, 3, 4]


def test_single_sample_stream_is_never_covered(spark):
    row = spark.createDataFrame([(at(0),)], "t timestamp_ntz")
    t = F.col("t")
    assert row.select(covers(t, t, t, t)).first()[0] is False


def test_several_dimensions(spark):
    df = spark.createDataFrame([(at(i), i, w, w) for i in range(5) for w in range(4)], "time timestamp_ntz, _pos int, w int, w_index int")
    rows = select_ranges(df, {"time": (at(1), at(3)), "w": (1, 3)}, positions={"time": "_pos", "w": "w_index"}).collect()
    assert sorted((r["_pos"], r["w"]) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_projection(stream):
    assert stream.project(["time", "v", "nothing"]).df.columns == ["time", "v", "_pos"]
    assert stream.project(["time"]).reset().df.columns == stream.base.columns
    with pytest.raises(TypeError):
        project(stream.df, "time")
    assert axis_columns("v", "v", "") == ["v", "time"]
    assert swap_key(stream.df, "v").columns[0] == "v"


def test_unknown_dimension(stream):
    with pytest.raises(ValueError, match="'depth' is not a dimension"):
        stream.select(depth=(0, 1))


def test_unknown_stream(series):
    with pytest.raises(ValueError, match="no data stream"):
        describe_stream(build_manifest(series(A=A)), "B")


def test_raster_above_the_threshold(stream):
    result = plot_request({"A": stream}, "time", "v", at(0).isoformat(), at(25).isoformat(), shade_threshold=1, canvas=(2, 2))
    assert result.shaded and result.count == 2
    assert {(r["px"], r["py"], r["v"]) for r in result.data.collect()} == {(0, 0, 0.0), (1, 1, 10.0)}


def test_two_streams_are_aligned(series):
    streams = {n: Stream(n, series(**{n: A}).drop("stream").withColumnRenamed("v", f"v_{n}")) for n in "AB"}
    result = plot_request(streams, "time", "v_A", at(5).isoformat(), at(25).isoformat(), "v_B")
    rows = result.data.collect()
    # Only the sample at 10 s survives the cut; it is exact there and fills the rest of the grid.
    assert result.count == 20 and {(r["v_A"], r["v_B"]) for r in rows} == {(10.0, 10.0)}


def test_lists(stream):
    result = plot_request({"A": stream}, "time", "v", at(0).isoformat(), at(25).isoformat())
    assert column_lists(result).first()["v"] == [0.0, 10.0]
    with pytest.raises(ValueError, match="more than 1 rows"):
        column_lists(result, limit=1)


def test_list_pages(spark):
    df = spark.range(1_000).select((999 - F.col("id")).alias("v"), (F.col("id") % 7).alias("w")).repartition(6)
    result = PlotResult(df, 1_000, False, "")
    pages = {r.page: (r.v, r.w) for r in list_pages(result, 300, ["v"]).collect()}
    assert sorted(pages) == [0, 1, 2, 3] and [v for p in range(4) for v in pages[p][0]] == list(range(1_000))
    assert all(w == [(999 - v) % 7 for v in vs] for vs, w in pages.values())
    assert list_pages(PlotResult(df.limit(0), 0, False, ""), 10, ["v"]).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        list_pages(result, 0, ["v"])


def test_stored_stream_prunes_days(spark, series, tmp_path):
    df = series(A=[(i * 3600, i) for i in range(96)])
    write_stream(df.drop("stream"), str(tmp_path), "A")
    stream = open_stream(spark, str(tmp_path), "A", time_ordered=True)
    cut = stream.select(time=slice("2024-01-02", "2024-01-03")).df
    assert sorted(r["v"] for r in cut.collect()) == list(range(24, 48))
    plan = cut._jdf.queryExecution().explainString(cut.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(time,2024-01-02" in plan and "LessThanOrEqual(time,2024-01-03" in plan


def test_download(spark, stream, tmp_path):
    done = download_request({"A": stream}, "time", "v", text(0), text(25), str(tmp_path), download_format="csv")
    assert (done.n_files, done.n_rows) == (1, 2)
    none = download_request({"A": stream}, "time", "v", text(12), text(18), str(tmp_path))
    assert none.path is None and none.status == "failed"


def test_fetch(stream, tmp_path):
    request = {"ref": "A,A", "x": "time", "y": "v", "start_dt": text(0), "end_dt": text(25)}
    assert fetch(request, {"A": stream}).count == 2
    done = fetch({**request, "download": True, "download_format": ""}, {"A": stream}, str(tmp_path))
    assert done.n_rows == 2
    with pytest.raises(ValueError, match="no data stream named B"):
        fetch({**request, "ref": "A,B"}, {"A": stream})
    with pytest.raises(ValueError, match="folder"):
        fetch({**request, "download": True}, {"A": stream})


def test_admission_by_time_bytes(stream):
    from sensorframe.plans.fetch import prepare

    ready = prepare({"A": stream}, "time", "v", text(5), text(25), max_dimension_bytes=31)
    assert ready.merged is None and ready.msg == "Max dimension size of 32.0 bytes is too large at this time"


def test_preview(stream):
    rows = {r["variable"]: r for r in stream.preview().collect()}
    assert (rows["v"]["n_values"], rows["v"]["low"], rows["v"]["high"], rows["v"]["stream"]) == (4, "0.0", "30.0", "A")
