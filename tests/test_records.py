"""Records of CSV files against the parser of the standard library, and NaN as no value."""

import csv
import io
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorframe.operators.merge import merge_conflicts, merge_on, union_by_name
from sensorframe.operators.raster import rasterize
from sensorframe.operators.resample import resample
from sensorframe.plans.plot import plot
from sensorframe.sources.samples import header_records, read_cruises, read_records


def some_file(rng, columns, rows):
    """A CSV text with commas, quotes, line breaks and blank lines, and its rows."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    cells = ["plain", "with, comma", 'a "quoted" word', "two\nlines", 'three\n\n"odd\nlines', "", "ü", "7"]
    table = [[f"c{i}" for i in range(columns)]] + [[rng.choice(cells) for _ in range(columns)] for _ in range(rows)]
    for row in table:
        writer.writerow(row)
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue(), [r for r in table if any(r) or columns > 1]


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_records_across_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    expected = {}
    for i in range(4):
        text, rows = some_file(rng, 2 + i, 60)
        path = tmp_path / f"f{i}.csv"
        path.write_text(text)
        expected[str(path)] = rows
    records = read_records(spark, list(expected))
    assert spark.read.text(list(expected)).rdd.getNumPartitions() > 20
    found = {}
    for r in sorted(records.collect(), key=lambda r: (r.file, r.place)):
        found.setdefault(r.file, []).append(next(csv.reader(io.StringIO(r.record))))
    assert found == expected
    heads = {r.file: r.record for r in header_records(records).collect()}
    assert heads == {f: ",".join(rows[0]) for f, rows in expected.items()}


def test_files_of_many_headers(spark, tmp_path, small_splits):
    texts = {
        "a": 'Cruise,"Start\nTime [UTC]",Station\nX1,"2016-01-01 00:00:00","Slope\nBase"\nX1,,"say ""so"", twice"\n',
        "b": "﻿Station,Cruise,Extra\nMid Plate,X2,-9999999,beyond\n\nOnly\n",
        "c": "",
        "d": "Cruise\n",
    }
    rows = []
    for i, (name, text) in enumerate(texts.items()):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        rows.append((name, "RS", str(path), i))
    schema = "cruise_id string, array_rd string, summary_url string, source_order bigint"
    samples, labels = read_cruises(spark, spark.createDataFrame(rows, schema))
    assert samples.columns == ["cruise", "extra", "start_time", "station", "cruise_id", "array_rd"]
    found = sorted(((r.cruise_id, r.cruise, r.extra, r.start_time, r.station) for r in samples.collect()), key=str)
    assert found == sorted(
        [
            ("a", "X1", None, "2016-01-01 00:00:00", "Slope\nBase"),
            ("a", "X1", None, None, 'say "so", twice'),
            ("b", "X2", None, None, "Mid Plate"),
            ("b", None, None, None, "Only"),
        ],
        key=str,
    )
    units = {r.name: (r.display_name, r.unit) for r in labels.collect()}
    assert units["start_time"] == ("Start Time", "UTC")
    only_empty = spark.createDataFrame(rows[2:3], schema)
    samples, labels = read_cruises(spark, only_empty)
    assert samples.count() == labels.count() == 0
    assert read_cruises(spark, only_empty.limit(0))[0].count() == 0


def test_nan_lies_nowhere_on_a_raster(spark):
    rows = [(1.0, 1.0, 1.0), (2.0, float("nan"), 1.0), (3.0, 3.0, float("nan")), (4.0, 2.0, 5.0), (float("nan"), 2.0, 1.0)]
    points = spark.createDataFrame(rows, "x double, y double, c double")
    found = sorted(tuple(r) for r in rasterize(points, "x", "y", canvas=(3, 2)).collect())
    assert found == [(0, 0, 1.5, 1.5, 1.0, 1), (2, 1, 3.5, 2.5, 2.5, 2)]
    values = {(r.px, r.py): (r.value, r.n) for r in rasterize(points, "x", "y", "c", canvas=(3, 2)).collect()}
    assert values == {(0, 0): (1.0, 1), (2, 1): (5.0, 2)}
    assert plot(points, "x", "y", shade_threshold=0).data.where("isnan(x_center) or isnan(y_center)").count() == 0


def test_nan_is_no_value_in_a_merge(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, nan, 2.0), (2, nan, nan)], "t int, v double, w double")
    b = spark.createDataFrame([(1, 5.0, 2.0), (2, nan, 3.0)], "t int, v double, w double")
    assert sorted(tuple(r) for r in merge_on([a, b], "t").collect()) == [(1, 5.0, 2.0), (2, None, 3.0)]
    assert merge_conflicts([a, b], "t").count() == 0
    with pytest.raises(ValueError, match="at least one"):
        union_by_name([])


def test_nan_is_no_value_on_a_grid(series):
    df = series(A=[(0, 0), (1, float("nan")), (2, 2), (4, 4)])
    found = {r.time: r.v for r in resample(df, at(0), at(4)).collect()}
    assert found == {at(0): 0.0, at(1): None, at(2): 2.0, at(3): 3.0}
