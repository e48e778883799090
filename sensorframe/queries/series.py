"""Queries over streams: catalog, selection, resampling, merging, raster, row slices."""

from __future__ import annotations

import json
import uuid
import zlib
from datetime import timedelta

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.cftime import compact_time, decode_time, encode_time, time_text, to_micros, whole_hour
from sensorframe.functions.values import nans_to_null
from sensorframe.operators.asof import asof_join
from sensorframe.operators.flatten import flatten_arrays
from sensorframe.operators.merge import merge_conflicts, merge_on
from sensorframe.operators.ranges import row_slices
from sensorframe.operators.raster import rasterize
from sensorframe.operators.resample import ONE_DAY, align, grid_ticks, resample
from sensorframe.operators.select import (
    axis_columns,
    plot_points,
    project,
    select_ranges,
    select_time,
    stream_extents,
    swap_key,
)
from sensorframe.plans.fetch import fetch, plot_request
from sensorframe.queries.bindings import END, START, event_streams, table
from sensorframe.session import shared_folder
from sensorframe.sources.arrays import read_arrays
from sensorframe.sources.streams import (
    Stream,
    build_manifest,
    catalog,
    catalog_names,
    describe_stream,
    dimension_split,
    profile_variables,
    split_stream,
)

STREAMS = ("click", "error", "purchase", "signup", "view")
FIVE_MINUTES = timedelta(minutes=5)
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def single_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot request on one stream: project, cover, select, points."""
    click = split_stream(event_streams(spark, sf_dir), "click", time_ordered=True)
    return plot_request({"click": click}, "time", "value", "2024-01-03", "2024-01-28 06:00:00", "user_id").data


# A request on two streams, cut before it is aligned.
FETCH_START, FETCH_END = "2024-01-03T00:00:00", "2024-01-27T00:00:00"


def two_stream_download(spark, sf_dir):
    """Download request on two streams: cut, 1-second grid, merge, slices; shown as hourly means.

    Several events may share an instant: they lie at one position, and the cut leaves out
    the last instant.
    """
    rows = event_streams(spark, sf_dir).drop("user_id").withColumn("_pos", to_micros(F.col("time")))
    streams = {
        s: Stream(s, rows.where(F.col("stream") == s).drop("stream").withColumnRenamed("value", s), time_ordered=True)
        for s in ("click", "view")
    }
    request = {
        "ref": "click,view",
        "x": "time",
        "y": "click",
        "color": "view",
        "start_dt": FETCH_START,
        "end_dt": FETCH_END,
        "download": True,
    }
    done = fetch(request, streams, f"{shared_folder(spark)}/sensorframe-fetch-{uuid.uuid4().hex}", duplicates="all")
    data = spark.read.parquet(f"{done.path}/data")
    hour = whole_hour(F.col("time")).alias("hour")
    return data.groupBy(hour).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("click"), 6).alias("click"),
        F.round(F.avg("view"), 6).alias("view"),
    )


def catalog_list(spark, sf_dir):
    return catalog_names(build_manifest(event_streams(spark, sf_dir)))


def catalog_full(spark, sf_dir):
    spectra = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("spectra-"), "label").alias("stream"), F.col("vec_id").alias("time"), "embedding"
    )
    manifest = build_manifest(event_streams(spark, sf_dir)).unionByName(
        build_manifest(spectra, dims={"embedding": ["time", "wavelength"]})
    )
    return catalog(manifest).select(
        "stream",
        F.array_join("variables", ",").alias("variables"),
        F.array_join("dims", ",").alias("dims"),
        "n_values",
        "n_bytes",
    )


def stream_dimensions(spark, sf_dir):
    split = dimension_split(build_manifest(event_streams(spark, sf_dir)))
    return split.select("stream", "variable", F.array_join("dims", ",").alias("dims"), "is_dim")


def catalog_describe(spark, sf_dir):
    found = describe_stream(build_manifest(event_streams(spark, sf_dir)), "purchase")
    return found.select("stream", "variable", "dtype", "item_bytes", "n_values", "n_bytes", "is_dim")


def stream_profile(spark, sf_dir):
    streams = event_streams(spark, sf_dir).withColumn("time", time_text(F.col("time")))
    return profile_variables(streams)


def extents(spark, sf_dir):
    return stream_extents(event_streams(spark, sf_dir))


def project_axes(spark, sf_dir):
    return project(event_streams(spark, sf_dir), [*axis_columns("time", "value"), "absent"], keep=["stream"])


def time_select_reference(spark, sf_dir):
    return select_time(event_streams(spark, sf_dir), "2024-01-05", "2024-01-20T12:00:00Z", by=["stream"])


def time_select_ordered(spark, sf_dir):
    rows = event_streams(spark, sf_dir)
    return select_time(rows, "2024-01-05", "20240120T120000", by=["stream"], ordered=True)


def time_select_inclusive(spark, sf_dir):
    return select_time(event_streams(spark, sf_dir), "2024-01-05", "2024-01-20 12:00", mode="inclusive")


def unordered_select(spark, sf_dir):
    """Time is not ordered along the position here, so rows between matches stay."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("stream"), F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("_pos")
    )
    return select_time(orders, "1997-03-01", "1997-03-02", by=["stream"])


def dim_range_select(spark, sf_dir):
    ranges = {"l_quantity": (10.0, 20.0), "l_linenumber": slice(2, 4), "l_shipdate": None}
    return select_ranges(table(spark, sf_dir, "lineitem"), ranges, mode="inclusive")


def spectra_range_select(spark, sf_dir):
    long = flatten_arrays(table(spark, sf_dir, "embeddings"), ["embedding"], "wavelength")
    return select_ranges(long, {"wavelength": (8, 23), "label": (1, 5)}, mode="inclusive")


def flatten_spectra(spark, sf_dir):
    return flatten_arrays(table(spark, sf_dir, "embeddings"), ["embedding"], "wavelength")


def flatten_nulls(spark, sf_dir):
    """Two arrays of a dimension, some null, some empty, of unequal lengths."""
    v, whole = F.col("vec_id"), F.col("embedding")
    none = F.array().cast("array<float>")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(v % 5 == 0, F.lit(None)).when(v % 5 == 1, none).otherwise(F.slice(whole, 1, 4)).alias("a"),
        F.when(v % 3 != 0, F.slice(whole, 1, 2)).alias("b"),
    )
    return flatten_arrays(rows)


def ticks(spark, sf_dir):
    span = event_streams(spark, sf_dir).agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    return grid_ticks(spark, span["a"], span["b"], timedelta(minutes=1))


def interp_linear(spark, sf_dir):
    rows = event_streams(spark, sf_dir).drop("user_id")
    return _rounded(resample(rows, START, END, FIVE_MINUTES, duplicates="all", position="_pos"), "value")


def _gappy(spark, sf_dir):
    rows = event_streams(spark, sf_dir)
    return rows.withColumn("value", F.when(F.col("user_id") % 5 != 0, F.col("value"))).drop("user_id")


def gap_fill_short(spark, sf_dir):
    filled = resample(
        _gappy(spark, sf_dir), START, END, FIVE_MINUTES, max_gap=timedelta(hours=1), duplicates="all", position="_pos"
    )
    return _rounded(filled, "value")


def gap_fill_day(spark, sf_dir):
    filled = resample(
        _gappy(spark, sf_dir), START, END, FIVE_MINUTES, max_gap=ONE_DAY, duplicates="first", position="_pos"
    )
    return _rounded(filled, "value")


def categorical_previous(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.lit("all").alias("stream"), F.col("ts").alias("time"), F.col("event_type").alias("kind")
    )
    return resample(rows, START, END, FIVE_MINUTES, categorical="previous", duplicates="unique")


def align_merge(spark, sf_dir):
    """Five streams on one 1-second grid, merged; shown as hourly means and counts."""
    rows = event_streams(spark, sf_dir).drop("_pos", "user_id")
    merged = align(rows, START, END, duplicates="unique", streams=STREAMS, suffix=True)
    hour = whole_hour(F.col("time")).alias("hour")
    return merged.groupBy(hour).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"value_{s}").alias(f"n_{s}") for s in STREAMS],
        *[F.round(F.avg(f"value_{s}"), 6).alias(f"mean_{s}") for s in STREAMS],
    )


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _hourly(spark, sf_dir, only, **aggs):
    rows = event_streams(spark, sf_dir).withColumn("time", whole_hour(F.col("time")))
    if only:
        rows = rows.where(F.col("stream") == only)
    return rows.groupBy("time").agg(*[c.alias(n) for n, c in aggs.items()])


def merge_coalesce(spark, sf_dir):
    everyone = {"n_users": F.countDistinct("user_id")}
    a = _hourly(spark, sf_dir, "click", peak_click=F.max("value")).join(_hourly(spark, sf_dir, None, **everyone), "time")
    b = _hourly(spark, sf_dir, "view", peak_view=F.max("value")).join(_hourly(spark, sf_dir, None, **everyone), "time")
    return merge_on([a, b])


def merge_nan(spark, sf_dir):
    """Two frames of hourly peaks; where one holds a NaN the other has the value."""
    odd = F.hour("time") % 2 == 1
    peaks = _hourly(spark, sf_dir, None, peak=F.max("value"))
    a, b = (peaks.withColumn("peak", F.when(c, F.lit(float("nan"))).otherwise(F.col("peak"))) for c in (odd, ~odd))
    return merge_on([a, b])


def merge_conflict_rows(spark, sf_dir):
    a = _hourly(spark, sf_dir, "click", peak=F.max("user_id"), kind=F.lit("peak"))
    b = _hourly(spark, sf_dir, "view", peak=F.max("user_id"), kind=F.lit("peak"))
    return merge_conflicts([a, b])


def _shifted_orders(spark, sf_dir):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.timestamp_add("MINUTE", days * 18, start).alias("due")
    )


def _asof(direction):
    def query(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("ts", "value", "event_type")
        return asof_join(
            _shifted_orders(spark, sf_dir), events, "due", "ts", ["value", "event_type"], direction=direction
        )

    return query


def asof_by_stream(spark, sf_dir):
    orders = _shifted_orders(spark, sf_dir).withColumn(
        "stream", F.element_at(F.array(*[F.lit(s) for s in STREAMS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    )
    rows = event_streams(spark, sf_dir).select("stream", "time", "value")
    return asof_join(orders, rows, "due", "time", ["value"], by=["stream"], direction="nearest", tolerance=timedelta(minutes=30))


def raster_mean(spark, sf_dir):
    return _rounded(rasterize(event_streams(spark, sf_dir), "time", "value"), "y_center", "value")


def raster_nan(spark, sf_dir):
    """A tenth of the values is NaN: they lie on no pixel and move no bound."""
    rows = event_streams(spark, sf_dir)
    noisy = rows.withColumn("value", F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return _rounded(rasterize(noisy, "time", "value"), "y_center", "value")


def plot_raster(spark, sf_dir):
    """A plot request that asks for a raster above a number of rows."""
    click = split_stream(event_streams(spark, sf_dir), "click", time_ordered=True)
    ranges = "2024-01-03", "2024-01-28 06:00:00"
    found = plot_request({"click": click}, "time", "value", *ranges, shade_threshold=100)
    return _rounded(found.data, "y_center", "value")


def raster_color(spark, sf_dir):
    return _rounded(rasterize(event_streams(spark, sf_dir), "time", "value", "user_id"), "y_center", "value")


def raster_dense(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    cells = rasterize(rows, "l_quantity", "l_extendedprice", "l_discount", canvas=(120, 80), dense=True)
    return _rounded(cells, "x_center", "y_center", "value")


def points_plot(spark, sf_dir):
    rows = event_streams(spark, sf_dir)
    noisy = rows.withColumn("value", F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return plot_points(swap_key(noisy, "value"), "value", "user_id", "time")


def cf_roundtrip(spark, sf_dir):
    rows = event_streams(spark, sf_dir)
    seconds = encode_time(F.col("time"))
    hours = encode_time(F.col("time"), "hours since 2000-01-01")
    return rows.select(
        "_pos",
        F.round(seconds, 4).alias("seconds"),
        F.round(hours, 6).alias("hours"),
        decode_time(F.floor(seconds)).alias("whole_second"),
        decode_time(F.floor(hours), "hours since 2000-01-01").alias("whole_hour"),
        compact_time(F.col("time")).alias("compact"),
    )


def nan_cleaning(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_returnflag",
        F.when(F.col("l_quantity") > 25, float("nan")).otherwise(F.col("l_quantity")).alias("q"),
    )
    return nans_to_null(rows).groupBy("l_returnflag").agg(
        F.count("q").alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.count(F.lit(1)).alias("rows")
    )


def sliced_rows(spark, sf_dir):
    return row_slices(table(spark, sf_dir, "lineitem"), LINE_KEY, 7_000)


CHUNK = 1_000


def _write_chunks(root: str):
    """Writes the chunk files of one chunk of events; runs on the executors."""

    def write(chunk):
        files, base = arrow_fs.FileSystem.from_uri(root)
        chunk = chunk.sort_values("event_id")
        number = int(chunk["event_id"].iloc[0]) // CHUNK
        for name, kind in (("time", "<i8"), ("value", "<f8"), ("user_id", "<i4")):
            block = np.zeros(CHUNK, dtype=kind)
            block[: len(chunk)] = chunk[name].to_numpy()
            with files.open_output_stream(f"{base}/{name}/{number}") as out:
                out.write(zlib.compress(block.tobytes()))
        return pd.DataFrame({"n": [len(chunk)]})

    return write


def array_stream(spark, sf_dir):
    """Events stored as a chunked array folder, then opened as a stream table."""
    folder = f"{shared_folder(spark)}/sensorframe-arrays-{uuid.uuid4().hex}"
    root = folder if ":/" in folder else f"file://{folder}"
    files, base = arrow_fs.FileSystem.from_uri(root)
    rows = table(spark, sf_dir, "events").select(
        "event_id", to_micros(F.col("ts")).alias("time"), "value", "user_id"
    )
    n = rows.count()
    for name, kind in (("time", "<i8"), ("value", "<f8"), ("user_id", "<i4")):
        files.create_dir(f"{base}/{name}", recursive=True)
        array = {"shape": [n], "chunks": [CHUNK], "dtype": kind, "compressor": {"id": "zlib"}, "fill_value": None}
        attrs = {"_ARRAY_DIMENSIONS": ["time"], "units": "microseconds since 1970-01-01"}
        for part, content in ((".zarray", array), (".zattrs", attrs)):
            with files.open_output_stream(f"{base}/{name}/{part}") as out:
                out.write(json.dumps(content).encode())
    chunk = F.floor(F.col("event_id") / F.lit(CHUNK)).alias("chunk")
    rows.groupBy(chunk).applyInPandas(_write_chunks(root), "n bigint").agg(F.sum("n")).first()
    return read_arrays(spark, root)


SPECTRA_ROWS, SPECTRA_COLUMNS, SPECTRA_WIDTH = 128, 24, 64
#: Coordinates of the second dimension: 400, 402.5, ...
FIRST_WAVELENGTH, WAVELENGTH_STEP = 400.0, 2.5
ARRAY_RANGES = {"time": ("2024-01-01 00:50:00", "2024-01-01 02:50:00"), "wavelength": (455.0, 541.0)}


def _write_spectra(root: str):
    """Writes the chunk files of one stretch of rows, time and several columns of spectra; runs on the executors."""

    def write(rows):
        files, base = arrow_fs.FileSystem.from_uri(root)
        number = int(rows["vec_id"].iloc[0]) // SPECTRA_ROWS
        at = rows["vec_id"].to_numpy() % SPECTRA_ROWS
        time = np.full(SPECTRA_ROWS, -1, "<i8")
        time[at] = rows["vec_id"]
        wide = -(-SPECTRA_WIDTH // SPECTRA_COLUMNS) * SPECTRA_COLUMNS
        values = np.full((SPECTRA_ROWS, wide), np.nan, "<f4")
        for i, vector in zip(at, rows["embedding"]):
            if vector is not None:
                values[i, :SPECTRA_WIDTH] = vector
        blocks = {f"time/{number}": time}
        for j in range(wide // SPECTRA_COLUMNS):
            blocks[f"spectra/{number}.{j}"] = values[:, j * SPECTRA_COLUMNS : (j + 1) * SPECTRA_COLUMNS]
        for name, block in blocks.items():
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(zlib.compress(block.tobytes()))
        return pd.DataFrame({"n": [len(rows)]})

    return write


def _stored_spectra(spark, sf_dir) -> str:
    """Embeddings as a group of time, wavelength and two-dimensional spectra; its path."""
    folder = f"{shared_folder(spark)}/sensorframe-arrays-{uuid.uuid4().hex}"
    root = folder if ":/" in folder else f"file://{folder}"
    files, base = arrow_fs.FileSystem.from_uri(root)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    shapes = {
        "time": ([n], [SPECTRA_ROWS], "<i8", ["time"]),
        "spectra": ([n, SPECTRA_WIDTH], [SPECTRA_ROWS, SPECTRA_COLUMNS], "<f4", ["time", "wavelength"]),
        "wavelength": ([SPECTRA_WIDTH], [16], "<f8", ["wavelength"]),
    }
    for name, (shape, chunks, kind, dims) in shapes.items():
        files.create_dir(f"{base}/{name}", recursive=True)
        array = {"shape": shape, "chunks": chunks, "dtype": kind, "compressor": {"id": "zlib"}, "fill_value": None}
        attrs = {"_ARRAY_DIMENSIONS": dims, **({"units": "minutes since 2024-01-01"} if name == "time" else {})}
        for file, content in ((".zarray", array), (".zattrs", attrs)):
            with files.open_output_stream(f"{base}/{name}/{file}") as out:
                out.write(json.dumps(content).encode())
    wavelength = FIRST_WAVELENGTH + WAVELENGTH_STEP * np.arange(SPECTRA_WIDTH)
    for number, part in enumerate(np.split(wavelength, range(16, SPECTRA_WIDTH, 16))):
        with files.open_output_stream(f"{base}/wavelength/{number}") as out:
            out.write(zlib.compress(part.tobytes()))
    chunk = F.floor(F.col("vec_id") / SPECTRA_ROWS)
    rows.groupBy(chunk).applyInPandas(_write_spectra(root), "n bigint").agg(F.sum("n")).collect()
    return root


def _long_spectra(rows: DataFrame) -> DataFrame:
    return rows.select("_pos", "time", F.posexplode("spectra").alias("place", "value"))


def array_spectra(spark, sf_dir):
    """Two-dimensional chunks read as an array column, one row for each element."""
    return _long_spectra(read_arrays(spark, _stored_spectra(spark, sf_dir)))


def array_range(spark, sf_dir):
    """The same group cut in both dimensions: only chunks that hold a part of the cut are opened."""
    return _long_spectra(read_arrays(spark, _stored_spectra(spark, sf_dir), ARRAY_RANGES))


QUERIES = {
    "array_stream": array_stream,
    "array_spectra": array_spectra,
    "array_range": array_range,
    "single_plot": single_plot,
    "two_stream_download": two_stream_download,
    "catalog_list": catalog_list,
    "catalog_full": catalog_full,
    "catalog_describe": catalog_describe,
    "stream_dimensions": stream_dimensions,
    "stream_profile": stream_profile,
    "stream_extents": extents,
    "project_axes": project_axes,
    "time_select_reference": time_select_reference,
    "time_select_ordered": time_select_ordered,
    "time_select_inclusive": time_select_inclusive,
    "time_select_unordered": unordered_select,
    "dim_range_select": dim_range_select,
    "spectra_range_select": spectra_range_select,
    "flatten_spectra": flatten_spectra,
    "flatten_nulls": flatten_nulls,
    "grid_ticks": ticks,
    "interp_linear": interp_linear,
    "gap_fill_short": gap_fill_short,
    "gap_fill_day": gap_fill_day,
    "categorical_previous": categorical_previous,
    "align_merge": align_merge,
    "merge_coalesce": merge_coalesce,
    "merge_nan": merge_nan,
    "merge_conflicts": merge_conflict_rows,
    "asof_backward": _asof("backward"),
    "asof_forward": _asof("forward"),
    "asof_nearest": _asof("nearest"),
    "asof_by_stream": asof_by_stream,
    "raster_mean": raster_mean,
    "raster_nan": raster_nan,
    "plot_raster": plot_raster,
    "raster_color": raster_color,
    "raster_dense": raster_dense,
    "points_plot": points_plot,
    "cf_roundtrip": cf_roundtrip,
    "nan_cleaning": nan_cleaning,
    "sliced_rows": sliced_rows,
}

_STREAM = "SELECT event_type AS stream, ts AS time, value, user_id, event_id AS _pos FROM events"


def _resampled_sql(source: str, step: int, max_gap: int | None, start: str = START, end: str = END) -> str:
    """Common table expression ``filled(stream, t, v)`` over ``source(stream, t, v)``."""
    fill = "v" if max_gap is None else f"""
         CASE WHEN v IS NOT NULL THEN v
              WHEN coalesce(nt, g9) - coalesce(pt, g0) > {max_gap} THEN NULL
              WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv
              WHEN t - pt <= nt - t THEN pv ELSE nv END"""
    return f"""
  src AS ({source}),
  seg AS (SELECT stream, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM src
          WINDOW w AS (PARTITION BY stream ORDER BY t)),
  grid AS (SELECT stream, unnest(range(epoch_us(TIMESTAMP '{start}'), epoch_us(TIMESTAMP '{end}'), {step})) AS t
           FROM (SELECT DISTINCT stream FROM src)),
  j AS (SELECT g.stream, g.t, s.t AS ta, s.v AS va, s.t2 AS tb, s.v2 AS vb
        FROM grid g ASOF LEFT JOIN seg s ON g.stream = s.stream AND g.t >= s.t),
  lin AS (SELECT stream, t, CASE WHEN ta IS NULL THEN NULL WHEN t = ta THEN va WHEN tb IS NULL THEN NULL
                                 ELSE va + (vb - va) * (t - ta) / (tb - ta) END AS v FROM j),
  f AS (SELECT stream, t, v, min(t) OVER a AS g0, max(t) OVER a AS g9,
               last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt,
               last_value(v IGNORE NULLS) OVER p AS pv,
               first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt,
               first_value(v IGNORE NULLS) OVER n AS nv
        FROM lin
        WINDOW a AS (PARTITION BY stream),
               p AS (PARTITION BY stream ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               n AS (PARTITION BY stream ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT stream, t, {fill} AS v FROM f)"""


_GAPPY_SQL = (
    "SELECT event_type AS stream, epoch_us(ts) AS t, CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events"
)
_GRID_SQL = "SELECT stream, make_timestamp(t) AS time, round(v, 6) AS value FROM filled"
_SHIFTED_SQL = (
    "SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_minutes(18 * date_diff('day', DATE '1995-01-01', "
    "CAST(o_orderdate AS DATE))) AS due FROM orders"
)


def _reference_sql(low: str, high: str) -> str:
    return f"""
  WITH s AS ({_STREAM}),
  b AS (SELECT stream, min(_pos) AS a, max(_pos) AS z FROM s
        WHERE time BETWEEN TIMESTAMP '{low}' AND TIMESTAMP '{high}' GROUP BY 1)
  SELECT s.* FROM s JOIN b USING (stream) WHERE _pos >= a AND _pos < z"""


_NO_TENTH = "CASE WHEN user_id % 10 <> 0 THEN value END"


def _raster_sql(source: str, x: str, y: str, v: str, w: int, h: int, x_out: str) -> str:
    return f"""
  WITH p AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({v} AS DOUBLE) AS v FROM {source}),
  b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
  c AS (SELECT CAST(least(floor((x - x0) * {w} / (x1 - x0)), {w - 1}) AS INTEGER) AS px,
               CAST(least(floor((y - y0) * {h} / (y1 - y0)), {h - 1}) AS INTEGER) AS py, v FROM p, b),
  g AS (SELECT px, py, avg(v) AS value, count(*) AS n FROM c GROUP BY 1, 2)
  SELECT px, py, {x_out} AS x_center, round(y0 + (py + 0.5::DOUBLE) * (y1 - y0) / {h}, 6) AS y_center,
         round(value, 6) AS value, n"""


# The positional cut leaves out the last matching row.
_CLICK_CUT = """(SELECT * FROM events WHERE event_type = 'click'
         AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28 06:00:00'
         QUALIFY row_number() OVER (ORDER BY ts DESC) > 1)"""
_TIME_CENTER = "make_timestamp(CAST(round(x0 + (px + 0.5::DOUBLE) * (x1 - x0) / 888) AS BIGINT))"


def _asof_sql(direction: str) -> str:
    before = f"""
  WITH o AS ({_SHIFTED_SQL}), e AS (SELECT ts, event_type, value FROM events),
  p AS (SELECT o.*, e.ts AS pt, e.event_type AS pk, e.value AS pv FROM o ASOF LEFT JOIN e ON o.due >= e.ts),
  b AS (SELECT p.*, e.ts AS nt, e.event_type AS nk, e.value AS nv FROM p ASOF LEFT JOIN e ON p.due <= e.ts)"""
    use = {
        "backward": "TRUE",
        "forward": "FALSE",
        "nearest": "pt IS NOT NULL AND (nt IS NULL OR due - pt <= nt - due)",
    }[direction]
    return f"""{before}
  SELECT o_orderkey, due, CASE WHEN {use} THEN pt ELSE nt END AS matched_time,
         CASE WHEN {use} THEN pk ELSE nk END AS event_type, CASE WHEN {use} THEN pv ELSE nv END AS value FROM b"""


_SPECTRA = "SELECT vec_id, embedding, label FROM embeddings"
_SPECTRA_SQL = f"""WITH k AS (SELECT vec_id, embedding, unnest(range({SPECTRA_WIDTH})) AS i FROM embeddings),
  e AS (SELECT vec_id AS _pos, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS time, CAST(i AS INTEGER) AS place,
        CASE WHEN isnan(embedding[i + 1]) THEN NULL ELSE CAST(embedding[i + 1] AS DOUBLE) END AS value FROM k)"""

ORACLES = {
    "array_spectra": f"{_SPECTRA_SQL} SELECT _pos, time, place, value FROM e",
    "array_range": f"""{_SPECTRA_SQL},
  w AS (SELECT min(place) AS low, max(place) AS high FROM e WHERE {FIRST_WAVELENGTH} + {WAVELENGTH_STEP} * place BETWEEN 455 AND 541)
  SELECT _pos, time, CAST(place - low AS INTEGER) AS place, value FROM e, w
  WHERE time BETWEEN TIMESTAMP '2024-01-01 00:50:00' AND TIMESTAMP '2024-01-01 02:50:00' AND place BETWEEN low AND high""",
    "array_stream": "SELECT event_id AS _pos, ts AS time, value, user_id FROM events",
    "single_plot": """
  WITH s AS (SELECT * FROM events WHERE event_type = 'click'),
  b AS (SELECT min(event_id) AS a, max(event_id) AS z FROM s
        WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28 06:00:00')
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, value, user_id FROM s, b WHERE event_id >= a AND event_id < z""",
    "two_stream_download": "WITH"
    + _resampled_sql(
        f"""SELECT event_type AS stream, epoch_us(ts) AS t, value AS v FROM events
            WHERE event_type IN ('click', 'view') AND ts BETWEEN TIMESTAMP '{FETCH_START}' AND TIMESTAMP '{FETCH_END}'
            QUALIFY ts < max(ts) OVER (PARTITION BY event_type)""",
        1_000_000,
        86_400_000_000,
        FETCH_START,
        FETCH_END,
    )
    + """
  SELECT date_trunc('hour', make_timestamp(t)) AS hour, count(DISTINCT t) AS n,
         round(avg(v) FILTER (stream = 'click'), 6) AS click, round(avg(v) FILTER (stream = 'view'), 6) AS view
  FROM filled GROUP BY 1""",
    "catalog_list": "SELECT DISTINCT event_type AS stream FROM events",
    "catalog_full": """
  SELECT event_type AS stream, 'user_id,value' AS variables, 'time' AS dims, count(*) AS n_values,
         CAST(24 * count(*) AS BIGINT) AS n_bytes FROM events GROUP BY 1
  UNION ALL
  SELECT 'spectra-' || CAST(label AS VARCHAR), 'embedding', 'time,wavelength', CAST(sum(len(embedding)) AS BIGINT),
         CAST(8 * count(*) + 4 * sum(len(embedding)) AS BIGINT) FROM embeddings GROUP BY 1""",
    "catalog_describe": """
  SELECT 'purchase' AS stream, v.variable, v.dtype, 8 AS item_bytes, n AS n_values, 8 * n AS n_bytes, v.is_dim
  FROM (SELECT count(*) AS n FROM events WHERE event_type = 'purchase'),
       (VALUES ('time', 'timestamp_ntz', TRUE), ('value', 'double', FALSE), ('user_id', 'bigint', FALSE))
       AS v(variable, dtype, is_dim)""",
    "stream_dimensions": """
  SELECT DISTINCT event_type AS stream, v.variable, 'time' AS dims, v.variable = 'time' AS is_dim
  FROM events, (VALUES ('time'), ('value'), ('user_id')) AS v(variable)""",
    "stream_profile": """
  SELECT event_type AS stream, 'time' AS variable, count(ts) AS n_values, count(*) - count(ts) AS n_nulls,
         strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS low, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS high,
         'string' AS dtype, CAST(sum(strlen(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'))) AS BIGINT) AS n_bytes
  FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'value', count(value), count(*) - count(value), CAST(min(value) AS VARCHAR),
         CAST(max(value) AS VARCHAR), 'double', 8 * count(*) FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'user_id', count(user_id), count(*) - count(user_id), CAST(min(user_id) AS VARCHAR),
         CAST(max(user_id) AS VARCHAR), 'bigint', 8 * count(*) FROM events GROUP BY 1""",
    "stream_extents": "SELECT event_type AS stream, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1",
    "project_axes": "SELECT event_type AS stream, ts AS time, value FROM events",
    "time_select_reference": _reference_sql("2024-01-05", "2024-01-20 12:00:00"),
    "time_select_ordered": _reference_sql("2024-01-05", "2024-01-20 12:00:00"),
    "time_select_inclusive": f"""
  SELECT * FROM ({_STREAM}) WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
    "time_select_unordered": """
  WITH s AS (SELECT o_orderstatus AS stream, o_orderdate AS time, o_orderkey AS _pos FROM orders),
  b AS (SELECT stream, min(_pos) AS a, max(_pos) AS z FROM s
        WHERE time BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-02' GROUP BY 1)
  SELECT s.* FROM s JOIN b USING (stream) WHERE _pos >= a AND _pos < z""",
    "dim_range_select": "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber BETWEEN 2 AND 4",
    "spectra_range_select": f"""
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS wavelength, embedding[i] AS embedding
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM ({_SPECTRA}))
  WHERE i BETWEEN 9 AND 24 AND label BETWEEN 1 AND 5""",
    "flatten_spectra": f"""
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS wavelength, embedding[i] AS embedding
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM ({_SPECTRA}))""",
    "flatten_nulls": """
  WITH r AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 5 = 1 THEN [] ELSE embedding[1:4] END AS x,
                    CASE WHEN vec_id % 3 <> 0 THEN embedding[1:2] END AS y FROM embeddings),
  n AS (SELECT *, greatest(coalesce(len(x), 0), coalesce(len(y), 0)) AS m FROM r)
  SELECT vec_id, CASE WHEN m > 0 THEN CAST(i AS INTEGER) END AS index, x[i + 1] AS a, y[i + 1] AS b
  FROM (SELECT *, unnest(range(0, greatest(m, 1))) AS i FROM n)""",
    "grid_ticks": """
  SELECT make_timestamp(unnest(range(epoch_us(a), epoch_us(b), 60000000))) AS time
  FROM (SELECT min(ts) AS a, max(ts) AS b FROM events)""",
    "interp_linear": "WITH"
    + _resampled_sql("SELECT event_type AS stream, epoch_us(ts) AS t, value AS v FROM events", 300_000_000, None)
    + _GRID_SQL,
    "gap_fill_short": "WITH" + _resampled_sql(_GAPPY_SQL, 300_000_000, 3_600_000_000) + _GRID_SQL,
    "gap_fill_day": "WITH" + _resampled_sql(_GAPPY_SQL, 300_000_000, 86_400_000_000) + _GRID_SQL,
    "categorical_previous": f"""
  SELECT 'all' AS stream, g.t AS time, e.event_type AS kind
  FROM (SELECT unnest(range(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 5 MINUTE)) AS t) g
  ASOF LEFT JOIN events e ON g.t >= e.ts""",
    "align_merge": "WITH"
    + _resampled_sql(
        "SELECT event_type AS stream, epoch_us(ts) AS t, value AS v FROM events", 1_000_000, 86_400_000_000
    )
    + "SELECT date_trunc('hour', make_timestamp(t)) AS hour, count(DISTINCT t) AS n, "
    + ", ".join(f"count(v) FILTER (stream = '{s}') AS n_{s}" for s in STREAMS)
    + ", "
    + ", ".join(f"round(avg(v) FILTER (stream = '{s}'), 6) AS mean_{s}" for s in STREAMS)
    + " FROM filled GROUP BY 1",
    "merge_coalesce": """
  WITH u AS (SELECT date_trunc('hour', ts) AS time, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1),
  a AS (SELECT date_trunc('hour', ts) AS time, max(value) AS peak_click FROM events WHERE event_type = 'click'
        GROUP BY 1),
  b AS (SELECT date_trunc('hour', ts) AS time, max(value) AS peak_view FROM events WHERE event_type = 'view'
        GROUP BY 1)
  SELECT time, peak_click, n_users, peak_view FROM (SELECT * FROM a FULL JOIN b USING (time)) JOIN u USING (time)""",
    "merge_conflicts": """
  WITH a AS (SELECT date_trunc('hour', ts) AS time, max(user_id) AS p FROM events WHERE event_type = 'click'
             GROUP BY 1),
  b AS (SELECT date_trunc('hour', ts) AS time, max(user_id) AS q FROM events WHERE event_type = 'view' GROUP BY 1)
  SELECT time, 'peak' AS variable, CAST(least(p, q) AS VARCHAR) AS low, CAST(greatest(p, q) AS VARCHAR) AS high
  FROM a JOIN b USING (time) WHERE p <> q""",
    "asof_backward": _asof_sql("backward"),
    "asof_forward": _asof_sql("forward"),
    "asof_nearest": _asof_sql("nearest"),
    "asof_by_stream": f"""
  WITH o AS (SELECT *, ['click', 'error', 'purchase', 'signup', 'view'][o_orderkey % 5 + 1] AS stream
             FROM ({_SHIFTED_SQL})),
  e AS (SELECT event_type AS stream, ts, value FROM events),
  p AS (SELECT o.*, e.ts AS pt, e.value AS pv FROM o ASOF LEFT JOIN e ON o.stream = e.stream AND o.due >= e.ts),
  b AS (SELECT p.*, e.ts AS nt, e.value AS nv FROM p ASOF LEFT JOIN e ON p.stream = e.stream AND p.due <= e.ts),
  c AS (SELECT o_orderkey, due, stream,
               CASE WHEN pt IS NOT NULL AND (nt IS NULL OR due - pt <= nt - due) THEN pt ELSE nt END AS mt,
               CASE WHEN pt IS NOT NULL AND (nt IS NULL OR due - pt <= nt - due) THEN pv ELSE nv END AS mv FROM b)
  SELECT o_orderkey, due, stream,
         CASE WHEN abs(epoch_us(due) - epoch_us(mt)) <= 1800000000 THEN mt END AS matched_time,
         CASE WHEN abs(epoch_us(due) - epoch_us(mt)) <= 1800000000 THEN mv END AS value FROM c""",
    "plot_raster": _raster_sql(_CLICK_CUT, "epoch_us(ts)", "value", "value", 888, 450, _TIME_CENTER) + " FROM g, b",
    "raster_nan": _raster_sql("events", "epoch_us(ts)", _NO_TENTH, _NO_TENTH, 888, 450, _TIME_CENTER).replace(
        "FROM p, b)", "FROM p, b WHERE y IS NOT NULL)"
    )
    + " FROM g, b",
    "merge_nan": "SELECT date_trunc('hour', ts) AS time, max(value) AS peak FROM events GROUP BY 1",
    "raster_mean": _raster_sql("events", "epoch_us(ts)", "value", "value", 888, 450, _TIME_CENTER) + " FROM g, b",
    "raster_color": _raster_sql("events", "epoch_us(ts)", "value", "user_id", 888, 450, _TIME_CENTER) + " FROM g, b",
    "raster_dense": f"""
  WITH sparse AS ({
        _raster_sql(
            "lineitem",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            120,
            80,
            "round(x0 + (px + 0.5::DOUBLE) * (x1 - x0) / 120, 6)",
        )
    } FROM g, b),
  e AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(max(l_quantity) AS DOUBLE) AS x1,
               CAST(min(l_extendedprice) AS DOUBLE) AS y0, CAST(max(l_extendedprice) AS DOUBLE) AS y1 FROM lineitem),
  canvas AS (SELECT CAST(x.range AS INTEGER) AS px, CAST(y.range AS INTEGER) AS py FROM range(120) x, range(80) y)
  SELECT canvas.px, canvas.py, round(x0 + (canvas.px + 0.5::DOUBLE) * (x1 - x0) / 120, 6) AS x_center,
         round(y0 + (canvas.py + 0.5::DOUBLE) * (y1 - y0) / 80, 6) AS y_center, value, coalesce(n, 0) AS n
  FROM canvas LEFT JOIN sparse ON canvas.px = sparse.px AND canvas.py = sparse.py, e""",
    "points_plot": """
  SELECT CASE WHEN user_id % 10 <> 0 THEN value END AS value, user_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time FROM events""",
    "cf_roundtrip": """
  SELECT event_id AS _pos, round(epoch_us(ts) / 1e6 + 2208988800, 4) AS seconds,
         round((epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) / 3.6e9, 6) AS hours,
         date_trunc('second', ts) AS whole_second, date_trunc('hour', ts) AS whole_hour,
         strftime(ts, '%Y%m%dT%H%M%S') AS compact FROM events""",
    "nan_cleaning": """
  SELECT l_returnflag, count(q) AS n, round(avg(q), 6) AS mean, count(*) AS rows
  FROM (SELECT l_returnflag, CASE WHEN l_quantity <= 25 THEN l_quantity END AS q FROM lineitem) GROUP BY 1""",
    "sliced_rows": f"""
  SELECT *, row_index // 7000 AS slice_id
  FROM (SELECT *, row_number() OVER (ORDER BY {", ".join(LINE_KEY)}) - 1 AS row_index
        FROM lineitem)""",
}
