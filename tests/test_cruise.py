from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorframe.operators.clean import cast_measurements, drop_empty_columns, invalid_values, parse_times
from sensorframe.operators.labels import keyed_labels, lookup_labels, merge_labels
from sensorframe.operators.split import derive_columns, discrete_columns, pick_sensors, profile_columns
from sensorframe.plans.cruise import load_cruises, store_cruises
from sensorframe.sources.samples import read_cruises, read_labels, read_samples, read_sources, to_records

HEAD = (
    "Cruise,Station,Start Time [UTC],CTD Temperature 1 [deg C],CTD Temperature 2 [deg C],CTD Conductivity 1,"
    "CTD Conductivity 2,CTD Salinity 1,CTD Salinity 2,CTD Pressure [db]"
)
RS = HEAD + ''',Discrete Fluorescense [ug/L],Calculated DIC,Comment
TN1,Slope Base,2016-07-01T10:00:00Z,1.5,9,3,4,35,36,100,0.5,-9999999,"kept, quoted"
TN1,Axial Caldera,2016-07-02 11:00:00,-9999999,2.5,bad,4,,36,200,n/a,-9999999,
-9999999,Slope Base,2016-07-01T10:00:00Z,1,1,1,1,1,1,1,1,1,
TN1,Slope Base,someday,1,1,1,1,1,1,1,1,1,
,,,,,,,,,,,,
'''
CE = HEAD + ''',CTD Pressure Flag,Discrete Oxygen [mL/L]
SR1,CEO2,7/3/2017 12:30:00,7,8,1,1,33,33,10,*0,5.5
SR1,CE09OSSM,20170704T000000,-9999999.0,,1,1,33,33,20,*0,trace
'''


@pytest.fixture()
def sources(spark, tmp_path):
    rows = []
    for i, (cruise, array, text) in enumerate([("TN1", "RS", RS), ("SR1", "CE", CE), ("SR0", "CE", CE.replace("SR1", "SR0"))]):
        path = tmp_path / f"{cruise} a+b 10%.csv"
        path.write_text(text)
        rows.append((cruise, array, str(path), i))
    return spark.createDataFrame(rows, "cruise_id string, array_rd string, summary_url string, source_order bigint")


def test_load(spark, sources, tmp_path):
    tables = load_cruises(spark, sources)
    profile = {(r["cruise_id"], r["area_rd"]): r for r in tables.profile.collect()}
    assert len(profile) == 6
    rs = profile["TN1", "oregon-slope-base"]
    assert (rs["ctd_temperature"], rs["date"], rs["array_rd"], rs["ctd_pressure"]) == (1.5, "2016-07", "RS", 100)
    second = profile["TN1", "axial-caldera"]
    assert (second["ctd_temperature"], second["ctd_conductivity"], second["ctd_salinity"]) == (2.5, 4, 36)
    assert profile["SR1", "oregon-shelf"]["ctd_temperature"] == 7 and profile["SR0", "washington-offshore"]["ctd_temperature"] is None
    assert sorted(tables.profile.columns) == sorted(
        "ctd_pressure cruise_id ctd_temperature ctd_conductivity ctd_salinity date area_rd array_rd".split()
    )
    assert "calculated_dic" not in tables.discrete.columns and "ctd_pressure_flag" not in tables.discrete.columns
    assert {r["discrete_oxygen"] for r in tables.discrete.collect()} == {None, 5.5}

    labels = {r["name"]: (r["display_name"], r["unit"]) for r in tables.labels.collect()}
    assert labels["ctd_temperature_1"] == ("CTD Temperature 1", "deg C")
    assert labels["discrete_fluorescence"] == ("Discrete Fluorescence", "ug/L")
    assert labels["discrete_oxygen"] == ("Discrete Oxygen", "mL/L") and labels["cruise"] == ("Cruise", None)

    root = str(tmp_path / "store")
    store_cruises(tables, sources, root, partitions=2)
    assert read_samples(spark, root, "profile").count() == 6
    assert read_labels(spark, f"{root}/labels").count() == len(labels)
    assert read_sources(spark, f"{root}/sources").count() == 3
    with pytest.raises(ValueError, match="Valid values: profile, discrete"):
        read_samples(spark, root, "other")


def test_strict_types(spark, sources):
    raw, _ = read_cruises(spark, sources)
    strict = cast_measurements(raw, strict=True)
    found = strict.where("cruise_id = 'TN1' AND station = 'Slope Base'").select("ctd_conductivity_1", "ctd_temperature_1")
    assert {r["ctd_conductivity_1"] for r in found.collect()} == {None}
    assert {1.5, 1.0} <= {r["ctd_temperature_1"] for r in found.collect()}


def test_wrong_source(spark, sources):
    with pytest.raises(ValueError, match="table.xlsx"):
        read_cruises(spark, sources.withColumn("summary_url", F.lit("/tmp/table.xlsx")))


def test_repeated_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Cruise,cruise\n1,2\n")
    rows = spark.createDataFrame([("c", "RS", str(tmp_path / "x.csv"))], "cruise_id string, array_rd string, summary_url string")
    with pytest.raises(ValueError, match="same column twice: cruise"):
        read_cruises(spark, rows)


def test_every_time_column_counts(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "2020-01-02", "a"), ("2020-01-01", "x", "b"), (None, "2020-01-02", "c")],
        "start_time string, bottle_closure_time string, k string",
    )
    rows = parse_times(df).collect()
    assert [(r["k"], r["start_time"]) for r in rows] == [("a", datetime(2020, 1, 1))]


def test_invalid_values(spark):
    df = spark.createDataFrame([("bad", "1"), ("bad", "n/a"), ("2", "-")], "ctd_a string, discrete_b string")
    assert sorted(map(tuple, invalid_values(df).collect())) == [("ctd_a", "bad", 2), ("discrete_b", "-", 1)]


def test_column_patterns():
    names = ["ctd_temperature", "ctd_temperature_1", "ctd_pressure", "ctd_pressure_flag", "ctd_depth", "date", "area_rd", "cruise_id", "discrete_x", "discrete_flag", "station"]
    assert profile_columns(names) == ["ctd_temperature", "ctd_pressure", "date", "area_rd", "cruise_id"]
    assert discrete_columns(names) == ["ctd_pressure", "date", "area_rd", "cruise_id", "discrete_x"]


def test_missing_sensor_column(spark):
    with pytest.raises(ValueError, match="ctd_temperature_2"):
        pick_sensors(spark.createDataFrame([(1.0,)], "ctd_temperature_1 double"))
    rows = spark.createDataFrame([(None, 2.0), (1.0, 3.0), (None, None)], "a_1 double, a_2 double")
    assert [r["a"] for r in pick_sensors(rows, ("a",)).collect()] == [2.0, 1.0, None]


def test_unknown_station_stops_the_load(spark):
    cols = ["ctd_temperature", "ctd_conductivity", "ctd_salinity"]
    df = spark.sql("SELECT timestamp_ntz'2020-01-01' AS start_time, 'Atlantis' AS station").select(
        "*", *[F.lit(1.0).alias(f"{c}_{i}") for c in cols for i in (1, 2)]
    )
    with pytest.raises(Exception, match="Unknown area: atlantis"):
        derive_columns(df).collect()
    assert derive_columns(df, "null").first()["area_rd"] is None


def test_empty_columns_alone(spark):
    df = spark.createDataFrame([(None, 1.0)], "calculated_dic double, x double")
    assert drop_empty_columns(df, ("calculated_dic", "calculated_pco2")).columns == ["x"]


def test_labels(spark):
    schema = "name string, display_name string, unit string"
    rs = spark.createDataFrame([("a", "A1", None)], schema)
    ce = spark.createDataFrame([("a", "A2", "m"), ("b", "B2", None)], schema)
    merged = merge_labels(rs, ce)
    assert {r["name"]: r["display_name"] for r in merged.collect()} == {"a": "A1", "b": "B2"}
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    found = {r["name"]: (r["display_name"], r["msg"]) for r in lookup_labels(names, merged).collect()}
    assert found == {"a": ("A1", None), "z": (None, "z not found.")}
    assert keyed_labels(merged).first()["labels"]["b"]["display_name"] == "B2"
    assert to_records(rs).first()["record"] == '{"name":"a","display_name":"A1","unit":null}'
