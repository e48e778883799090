from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorframe.functions.cftime import (
    bound_micros,
    decode_time,
    encode_time,
    from_micros,
    parse_bound,
    parse_datetime,
    parse_units,
    to_micros,
)
from sensorframe.functions.samples import repair_station, station_area
from sensorframe.functions.values import fingerprint, nans_to_null, size_text, to_measurement
from sensorframe.operators.labels import parse_headers

HEADERS = [
    ("CTD Temperature 1 [deg C]", "ctd_temperature_1", "CTD Temperature 1", "deg C"),
    ("Discrete Fluorescense [ug/L]", "discrete_fluorescence", "Discrete Fluorescence", "ug/L"),
    ("CTD pHAnalysis", "ctd_ph_analysis", "CTD pH Analysis", None),
    ("Start Positioning Depth [m]", "bottom_depth_at_start_position", "Bottom Depth at Start Position", "m"),
    ("CTD Transmissometer Flag", "ctd_beam_transmissometer_flag", "CTD Beam Transmissometer Flag", None),
    ("Bottle Closure-Time [UTC]", "bottle_closure-time", "Bottle Closure-Time", "UTC"),
    ("Oxygen (mL/L)", "oxygen", "Oxygen", None),
    ("discrete fluorescense", "discrete_fluorescense", "discrete fluorescense", None),
]

AREAS = [
    ("Slope Base", "oregon-slope-base"),
    ("Oregon Slope Base", "oregon-slope-base"),
    ("Axial Base", "axial-base"),
    ("Axial Caldera", "axial-caldera"),
    ("Hydrate Ridge", "southern-hydrate-ridge"),
    ("Mid Plate", "mid-plate"),
    ("CE01ISSM", "oregon-inshore"),
    ("CE02SHBP", "oregon-shelf"),
    ("CE04OSBP", "oregon-offshore"),
    ("CE06ISSM", "washington-inshore"),
    ("CE07SHSM", "washington-shelf"),
    ("CE09OSSM", "washington-offshore"),
]


def test_headers(spark):
    rows = parse_headers(spark.createDataFrame([(h[0],) for h in HEADERS], "header string")).collect()
    assert [tuple(r) for r in rows] == HEADERS


def test_header_without_words_is_an_error(spark):
    with pytest.raises(Exception, match="header without a name"):
        parse_headers(spark.createDataFrame([("[]",)], "header string")).collect()


def test_areas(spark):
    df = spark.createDataFrame(AREAS, "station string, area string")
    assert [r[0] for r in df.select(station_area(F.col("station"))).collect()] == [a for _, a in AREAS]


def test_unknown_area(spark):
    df = spark.createDataFrame([("Nowhere",)], "station string")
    with pytest.raises(Exception, match="Unknown area: nowhere"):
        df.select(station_area(F.col("station"))).collect()
    assert df.select(station_area(F.col("station"), "null")).first()[0] is None


def test_station_repair(spark):
    df = spark.createDataFrame([("CEO2", "CE"), ("Oregon Shelf", "CE"), ("CEO2", "RS")], "station string, a string")
    s, a = F.col("station"), F.col("a")
    assert [r[0] for r in df.select(repair_station(s, a)).collect()] == ["CE02", "0regon Shelf", "CEO2"]
    assert [r[0] for r in df.select(repair_station(s, a, True)).collect()] == ["CE02", "Oregon Shelf", "CEO2"]


def test_units():
    assert parse_units("seconds since 1900-01-01 00:00:00") == (1_000_000, datetime(1900, 1, 1))
    assert parse_units("days since 2000-01-01T12:00:00Z") == (86_400_000_000, datetime(2000, 1, 1, 12))
    assert parse_units("ms since 1970-01-01") == (1_000, datetime(1970, 1, 1))
    with pytest.raises(ValueError, match="calendar"):
        parse_units("days since 1900-01-01", "360_day")
    with pytest.raises(ValueError, match="unknown time unit"):
        parse_units("fortnights since 1900-01-01")
    with pytest.raises(ValueError, match="since"):
        parse_units("seconds")


def test_decode_and_encode(spark):
    df = spark.createDataFrame([(3_913_056_000.25,), (None,)], "v double")
    rows = df.select(decode_time(F.col("v")).alias("t")).select("t", encode_time(F.col("t")).alias("v")).collect()
    assert rows[0]["t"] == datetime(2024, 1, 1, 0, 0, 0, 250000) and rows[0]["v"] == 3_913_056_000.25
    assert rows[1]["t"] is None


def test_micros_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS t")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select(to_micros(F.col("t")).alias("u"), from_micros(to_micros(F.col("t"))).alias("t")).first()
        zoned = spark.sql("SELECT '2024-03-10T02:30:00+02:00' AS s").select(parse_datetime(F.col("s"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["u"] == bound_micros("2024-03-10 02:30:00") and row["t"] == datetime(2024, 3, 10, 2, 30)
    assert zoned == datetime(2024, 3, 10, 0, 30)


TIMES = {
    "2024-01-02": datetime(2024, 1, 2),
    "2024-01-02T03:04:05": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02 03:04:05.25": datetime(2024, 1, 2, 3, 4, 5, 250000),
    "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05+02:00": datetime(2024, 1, 2, 1, 4, 5),
    "20240102T030405": datetime(2024, 1, 2, 3, 4, 5),
    "20240102": datetime(2024, 1, 2),
    "1/2/2024 3:04": datetime(2024, 1, 2, 3, 4),
    "2024/1/2 3:04:05": datetime(2024, 1, 2, 3, 4, 5),
}


def test_datetime_text(spark):
    df = spark.createDataFrame([(t,) for t in [*TIMES, "soon", "", "2024-13-01"]], "s string")
    found = [r[0] for r in df.select(parse_datetime(F.col("s"))).collect()]
    assert found == [*TIMES.values(), None, None, None]
    assert [parse_bound(t) for t in TIMES] == list(TIMES.values())
    with pytest.raises(ValueError, match="soon"):
        parse_bound("soon")


def test_measurements(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("bad",), ("NaN",), ("-9999999",), ("-9999999.0",), (None,), ("5f",), ("1e3",)], "s string")
    assert [r[0] for r in df.select(to_measurement(F.col("s"))).collect()] == [1.5, 2.0, None, None, None, None, None, None, 1000.0]


def test_only_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (-999999.0, 3)], "v double, k int")
    assert [tuple(r) for r in nans_to_null(df).collect()] == [(None, 1), (float("inf"), 2), (-999999.0, 3)]


def test_size_text(spark):
    sizes = [0, 1023, 1024, 1536, 1024**2, 5 * 1024**3, 3 * 1024**4, 2048 * 1024**4, None]
    df = spark.createDataFrame([(s,) for s in sizes], "n bigint")
    expected = ["0.0 bytes", "1023.0 bytes", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "3.0 TB", "2048.0 TB", None]
    assert [r[0] for r in df.select(size_text(F.col("n"))).collect()] == expected


def test_fingerprint_separates_null_and_empty(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("a", "")], "x string, y string")
    keys = [r[0] for r in df.select(fingerprint(["x", "y"])).collect()]
    assert keys[0] == keys[2] != keys[1]
