"""Answers that are kept and given out again."""

import threading
from datetime import timedelta

import pytest
from conftest import at

from sensorframe.plans import results
from sensorframe.plans.results import fetch_once, result_key
from sensorframe.session import SharedFiles
from sensorframe.sources.streams import open_stream, write_stream


@pytest.fixture()
def catalog(spark, tmp_path):
    df = spark.createDataFrame([(at(i), float(i), i) for i in range(50)], "time timestamp_ntz, v double, _pos bigint")
    write_stream(df, str(tmp_path / "streams"), "s")
    return {"s": open_stream(spark, str(tmp_path / "streams"), "s")}


REQUEST = {"ref": "s", "x": "time", "y": "v", "start_dt": at(5).isoformat(), "end_dt": at(20).isoformat()}


def test_second_answer_starts_no_job(spark, catalog, tmp_path):
    root = str(tmp_path / "results")
    first = fetch_once(spark, REQUEST, catalog, root)
    assert (first.count, first.reused, first.status) == (15, False, "completed") and first.data.count() == 15
    spark.sparkContext.setJobGroup("again", "")
    again = fetch_once(spark, {**REQUEST, "z": "", "download": False}, catalog, root)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("again")
    spark.sparkContext.setJobGroup("tests", "")
    # Reading the schema of the kept rows is the only one.
    assert len(jobs) <= 1 and again.reused and again.count == 15
    assert sorted(map(tuple, again.data.collect())) == sorted(map(tuple, first.data.collect()))
    assert not fetch_once(spark, REQUEST, catalog, root, reuse=timedelta(seconds=-1)).reused
    assert not fetch_once(spark, {**REQUEST, "end_dt": at(21).isoformat()}, catalog, root).reused
    assert not fetch_once(spark, REQUEST, catalog, root, shade_threshold=3).reused


def test_downloads_and_failures(spark, catalog, tmp_path):
    root = str(tmp_path / "results")
    wanted = {**REQUEST, "download": True, "download_format": "csv"}
    done = [fetch_once(spark, wanted, catalog, root) for _ in range(2)]
    assert [d.reused for d in done] == [False, True] and done[0].path == done[1].path and done[1].n_files == 1
    bad = {**wanted, "download_format": "netcdf4"}
    assert [fetch_once(spark, bad, catalog, root).reused for _ in range(2)] == [False, False]
    gone = {**REQUEST, "start_dt": "2001-01-01", "end_dt": "2001-01-02"}
    assert [(a.reused, a.data, a.count) for a in (fetch_once(spark, gone, catalog, root) for _ in range(2))] == [(False, None, 0), (True, None, 0)]


def test_equal_requests_in_flight_are_computed_once(spark, catalog, tmp_path, monkeypatch):
    calls, real = [], results.fetch

    def slow(*args, **kwargs):
        calls.append(1)
        threading.Event().wait(2)
        return real(*args, **kwargs)

    monkeypatch.setattr(results, "fetch", slow)
    answers = []
    threads = [threading.Thread(target=lambda: answers.append(fetch_once(spark, REQUEST, catalog, str(tmp_path / "r")))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert len(calls) == 1 and sorted(a.reused for a in answers) == [False, True, True, True]


def test_a_lost_lease_is_taken_over(spark, catalog, tmp_path):
    root, files = str(tmp_path / "r"), SharedFiles(spark)
    held = f"{root}/leases/{result_key(REQUEST, catalog, {})}/0"
    assert files.create(held, "gone") and not files.create(held, "other") and files.read(held) == "gone"
    assert fetch_once(spark, REQUEST, catalog, root, lease=timedelta(seconds=1)).count == 15
    assert files.age(held) is None


def test_a_failing_call_frees_its_lease(spark, catalog, tmp_path):
    for _ in range(2):
        with pytest.raises(ValueError, match="no data stream"):
            fetch_once(spark, {**REQUEST, "ref": "s,t"}, catalog, str(tmp_path / "r"))


def test_key_follows_the_data(spark, catalog, tmp_path):
    before = result_key(REQUEST, catalog, {})
    df = spark.createDataFrame([(at(1), 1.0, 0)], "time timestamp_ntz, v double, _pos bigint")
    write_stream(df, str(tmp_path / "streams"), "s")
    assert result_key(REQUEST, {"s": open_stream(spark, str(tmp_path / "streams"), "s")}, {}) != before
