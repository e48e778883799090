import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators import joins
from sensorframe.operators.select import coverage, empty_streams, stream_extents
from sensorframe.plans.requests import (
    dedupe_requests,
    expand_requests,
    request_outcomes,
    request_totals,
    selected_rows,
    stream_sizes,
    with_request_id,
)
from sensorframe.sources.streams import build_manifest, catalog, profile_variables

A = [(0, 0), (10, 10), (20, 20), (30, 30)]


def text(second):
    return at(second).isoformat()


def batch(spark, *rows):
    """Requests ``(ref, start second, end second, download, format)``."""
    full = [(r[0], "time", "v", text(r[1]), text(r[2]), *(r[3:] or (False, "netcdf"))) for r in rows]
    schema = "ref string, x string, y string, start_dt string, end_dt string, download boolean, download_format string"
    return with_request_id(spark.createDataFrame(full, schema))


@pytest.fixture(scope="module")
def samples(series):
    return series(A=A, B=[(t + 1, v) for t, v in A], one=[(5, 1)])


CASES = [
    (("A", 5, 25), "plot", "plot"),
    (("A", -10, 40), "no data", "not covered"),
    (("A", 0, 5), "no data", "empty streams"),
    (("A", 12, 18), "failed", "no matching rows"),
    (("A", 25, 5), "failed", "no matching rows"),
    (("A,B", 5, 25), "plot", "plot"),
    (("A,A", 5, 25), "plot", "plot"),
    (("A,one", 4, 25), "no data", "not covered"),
    (("A,nothing", 5, 25), "failed", "unknown stream"),
    (("A,B", 5, 25, True, "csv"), "file", "download"),
    (("A,B", 1, 29, True, "csv"), "refused", "too many files"),
    (("A,B", 5, 25, True, "netcdf4"), "failed", "unknown format"),
    (("A,B", 5, 25, True, ""), "file", "download"),
]


@pytest.mark.parametrize("ordered", [False, True])
def test_outcomes(spark, samples, ordered):
    requests = batch(spark, *[c[0] for c in CASES])
    found = request_outcomes(
        requests, samples, build_manifest(samples), ordered, max_files=20, part_bytes={"csv": 16}
    ).collect()
    by_id = {r["request_id"]: r for r in found}
    for case, row in zip(CASES, requests.collect()):
        got = by_id[row["request_id"]]
        assert (got["outcome"], got["reason"]) == case[1:], case
    assert len(found) == len(CASES)


def test_admission(spark, samples):
    requests = batch(spark, ("A,B", 5, 25))
    row = request_outcomes(requests, samples, build_manifest(samples), max_dimension_bytes=63).first()
    assert (row["outcome"], row["reason"], row["total_dim_size"]) == ("no data", "too large", 64)


def test_unreadable_time(spark, samples):
    requests = with_request_id(
        spark.createDataFrame([("A", "time", "v", "soon", "later")], "ref string, x string, y string, start_dt string, end_dt string")
    )
    assert request_outcomes(requests, samples, build_manifest(samples)).first()["reason"] == "unreadable time"


def test_matches_without_broadcast(spark, samples, monkeypatch):
    expanded = expand_requests(batch(spark, ("A,B", 5, 25), ("A", 0, 5), ("B", -5, 100)))
    fast = sorted(map(tuple, selected_rows(expanded, samples).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("sensorframe.operators.ranks.fits_broadcast", lambda small: False)
    assert sorted(map(tuple, selected_rows(expanded, samples).collect())) == fast


def test_empty_list(spark, samples):
    expanded = expand_requests(batch(spark, ("A,B,one", 5, 25)))
    matched = spark.createDataFrame([(expanded.first()["request_id"], "A")], "request_id string, stream string")
    assert empty_streams(expanded, matched).first()["empty_streams"] == "B,one"


def test_equal_requests_collapse(spark):
    requests = batch(spark, ("A", 0, 1), ("A", 0, 1), ("A", 0, 2))
    assert dedupe_requests(requests.drop("request_id")).count() == 2


def test_sizes(spark, samples):
    expanded = expand_requests(batch(spark, ("A,B,A", 5, 25)))
    totals = request_totals(stream_sizes(expanded, build_manifest(samples))).first()
    assert (totals["total_size"], totals["total_dim_size"]) == (128, 64)
    assert totals["msg"] == "Max data request: 128.0 bytes" and totals["admitted"]


def test_manifest_of_arrays_and_text(spark):
    df = spark.createDataFrame(
        [("s", at(0), [1.0, 2.0], "ab"), ("s", at(1), [3.0], None)],
        "stream string, time timestamp_ntz, spectra array<double>, note string",
    )
    found = {r["variable"]: r for r in build_manifest(df, attrs={"spectra": {"units": "nm"}}).collect()}
    assert (found["spectra"]["n_values"], found["spectra"]["n_bytes"]) == (3, 24)
    assert found["spectra"]["dims"] == ["time", "spectra_index"] and found["spectra"]["attrs"] == {"units": "nm"}
    assert found["note"]["n_bytes"] == 2 and found["note"]["item_bytes"] is None and found["time"]["is_dim"]
    assert catalog(build_manifest(df)).first()["dims"] == ["spectra_index", "time"]
    profile = {r["variable"]: r for r in profile_variables(df).collect()}
    assert profile["note"]["n_nulls"] == 1


def test_requests_join_by_equality(spark, samples):
    expanded = expand_requests(batch(spark, ("A,B", 5, 25)))
    df = coverage(expanded, stream_extents(samples))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.where(F.col("covered")).count() == 2
