"""Tables repeated with shifted keys: every instant holds several samples, every day several times the rows."""

import os

import duckdb
import pytest
from conftest import at
from oracle import compare

from sensorframe.operators.resample import align, resample
from sensorframe.plans.export import measure
from sensorframe.plans.fetch import fetch
from sensorframe.plans.limits import plan_slices
from sensorframe.queries import requests
from sensorframe.sources.streams import split_stream
from test_resample import second, values

COPIES = 3


@pytest.fixture(scope="module")
def repeated(tmp_path_factory, sf_dir):
    """The folder of the small tables, with all events and line items three times."""
    folder = tmp_path_factory.mktemp("repeated")
    for table, key in (("events", "event_id"), ("lineitem", "l_orderkey")):
        shifted = f"SELECT t.* REPLACE ({key} + k * 1000000 AS {key}) FROM range({COPIES}) r(k), '{sf_dir}/{table}.parquet' t"
        duckdb.sql(f"COPY ({shifted}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


def expected(name, folder):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con.sql(entry.oracle_sql()[name]).df()


def found(spark, name, folder):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, folder).toPandas()


def test_samples_of_one_instant_all_stand(series):
    """The line before an instant ends in its first sample, the next begins in its last, which the tick has."""
    df = series(A=[(0, 0), (10, 20), (10, 7), (10, 4), (14.5, 1), (14.5, 13), (20, 2)], B=[(0, 1), (30, 1)])
    rows = resample(df, at(0), at(21), duplicates="all", position="_pos").where("stream = 'A'")
    wanted = {5: 10, 9: 18, 10: 4, 12: 4 - 3 * 2 / 4.5, 15: 13 - 11 * 0.5 / 5.5, 20: 2}
    assert {k: values(rows)[k] for k in wanted} == pytest.approx(wanted)
    # Without positions the values order them.
    rows = resample(df, at(0), at(21), duplicates="all", position=None, variables=["v"]).where("stream = 'A'")
    assert {k: values(rows)[k] for k in (5, 9, 10, 15)} == pytest.approx({5: 2, 9: 3.6, 10: 20, 15: 13 - 11 * 0.5 / 5.5})
    # A null sample is one too: the line to it or from it is null.
    df = series(A=[(0, 0), (10, None), (10, 4), (20, 6)])
    got = values(resample(df, at(0), at(21), duplicates="all", position="_pos"))
    assert all(got[i] is None for i in range(1, 10)) and (got[10], got[15], got[20]) == (4, 5, 6)
    # Outside the grid, and merged.
    df = series(A=[(-5, 0), (-5, 10), (5, 20), (5, 30)], B=[(-5, 1), (5, 1)])
    merged = align(df, at(0), at(8), duplicates="all", position="_pos", streams=["A", "B"], suffix=True, max_gap=second(1))
    assert values(merged, "v_A") == pytest.approx({0: 15, 1: 16, 2: 17, 3: 18, 4: 19, 5: 30, 6: None, 7: None}, nan_ok=True)


def test_unknown_kinds_of_duplicates_are_refused(series):
    with pytest.raises(ValueError, match="first, unique, all"):
        resample(series(A=[(0, 1)]), at(0), at(1), duplicates="some")


def test_interp_linear_of_repeated_events(spark, sf_dir, repeated):
    """Copies of a sample at its own instant change no line."""
    assert compare(found(spark, "interp_linear", repeated), expected("interp_linear", sf_dir)) is None


def test_gap_fill_short_of_repeated_events(spark, sf_dir, repeated):
    assert compare(found(spark, "gap_fill_short", repeated), expected("gap_fill_short", sf_dir)) is None


def test_two_stream_download_of_repeated_events(spark, sf_dir, repeated):
    """All samples of the last instant are cut, and those of one instant stand together."""
    assert compare(found(spark, "two_stream_download", repeated), expected("two_stream_download", sf_dir)) is None


def test_fetch_takes_the_choice_and_errs_without_one(spark, series, tmp_path):
    rows = series(A=[(0, 0), (5, 20), (5, 30), (20, 0), (25, 0)], B=[(0, 1), (20, 1), (25, 1)])
    streams = {s: split_stream(rows.withColumnRenamed("v", f"v_{s}"), s) for s in "AB"}
    request = {"ref": "A,B", "x": "time", "y": "v_A", "color": "v_B", "start_dt": at(0).isoformat(), "end_dt": at(25).isoformat()}
    with pytest.raises(ValueError, match="several samples at one time"):
        fetch(request, streams)
    points = fetch(request, streams, duplicates="all").data.toPandas().set_index("time")["v_A"]
    assert [points.iloc[i] for i in (4, 5, 8)] == pytest.approx([16, 30, 24])
    done = fetch({**request, "download": True}, streams, str(tmp_path), duplicates="all")
    assert done.n_rows == 25


@pytest.fixture
def many_files(monkeypatch):
    """Folders of a small size, so that an export has more than 2,000 of them."""
    monkeypatch.setattr(requests, "FOLDER_BYTES", 200)


def test_csv_roundtrip_in_many_files(spark, sf_dir, many_files):
    assert compare(found(spark, "csv_roundtrip", sf_dir), expected("csv_roundtrip", sf_dir)) is None


def test_json_roundtrip_in_many_files(spark, sf_dir, many_files):
    assert compare(found(spark, "json_roundtrip", sf_dir), expected("json_roundtrip", sf_dir)) is None


def planned_files(spark, monkeypatch, name, folder):
    """Files that the export of a query plans, or None where it refuses them; nothing is written."""

    class Planned(Exception):
        pass

    def only_planned(df, *_, part_bytes, max_files=None):
        plan = plan_slices(measure(df), part_bytes, max_files).first()
        raise Planned(plan["n_files"] if plan["allowed"] else None)

    monkeypatch.setattr(requests, "export", only_planned)
    monkeypatch.setattr(requests, "FOLDER_BYTES", 140)
    with pytest.raises(Planned) as planned:
        found(spark, name, folder)
    return planned.value.args[0]


def test_sliced_roundtrip_refuses_no_number_of_files(spark, sf_dir, monkeypatch):
    assert planned_files(spark, monkeypatch, "sliced_roundtrip", sf_dir) == 3_000


def test_export_manifest_refuses_no_number_of_files(spark, sf_dir, monkeypatch):
    assert planned_files(spark, monkeypatch, "export_manifest", sf_dir) == 3_000
