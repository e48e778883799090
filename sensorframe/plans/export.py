"""Exports: sized parts, time slices, manifest and result table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.cftime import parse_bound, to_micros
from sensorframe.functions.values import value_bytes
from sensorframe.operators.flatten import flatten_arrays
from sensorframe.operators.ranges import with_slices
from sensorframe.operators.resample import Grid
from sensorframe.plans.limits import (
    CSV_PART_BYTES,
    FINISHED,
    NO_DATA,
    REFUSED,
    SLICE_BYTES,
    UNKNOWN_FORMAT,
    plan_csv,
    plan_slices,
)

# The formats on offer; "netcdf" names the time-sliced export, stored as Parquet.
EXPORT_FORMATS = ("csv", "json", "netcdf")


@dataclass(frozen=True)
class ExportResult:
    path: str | None
    n_files: int
    n_rows: int
    status: str
    msg: str


def measure(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` and ``size`` in bytes of the stored values, in one row, or in one for each group of ``by``."""
    width = sum((value_bytes(f) for f in df.schema), F.lit(0).cast("bigint"))
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0).cast("bigint")).alias("size"))


def export_name(start: str, end: str) -> str:
    return "_".join(parse_bound(t).strftime("%Y%m%dT%H%M%S") for t in (start, end))


def export(
    df: DataFrame,
    root: str,
    start: str,
    end: str,
    download_format: str = "netcdf",
    streams: Sequence[str] = (),
    axes: Mapping[str, str] | None = None,
    time: str = "time",
    part_bytes: int | None = None,
    max_files: int | None = None,
    grid: Grid | None = None,
) -> ExportResult:
    """Write ``df`` in the asked format below ``root`` with a manifest beside it.

    ``grid``: the times of ``df``, if it has one row for each tick.

    With ``max_files``, more parts than that are refused with a message; without
    it any size is written. The table is read once to measure it and once to write it.
    """
    chosen = download_format or "netcdf"
    if chosen not in EXPORT_FORMATS:
        return ExportResult(None, 0, 0, "failed", UNKNOWN_FORMAT.format(kind=chosen))
    if chosen == "netcdf":
        plan = plan_slices(measure(df), part_bytes or SLICE_BYTES, max_files).first()
        kind = "NetCDF"
    else:
        df = flatten_arrays(df) if any(t.startswith("array") for _, t in df.dtypes) else df
        plan = plan_csv(measure(df), part_bytes or CSV_PART_BYTES, max_files).first()
        kind = chosen.upper()
    if plan["rows"] == 0:
        return ExportResult(None, 0, 0, "completed", NO_DATA.format(start=start, end=end))
    if not plan["allowed"]:
        return ExportResult(None, plan["n_files"], plan["rows"], "completed", REFUSED.format(kind=kind))

    path = f"{root}/{export_name(start, end)}"
    if chosen == "netcdf":
        whole = grid is not None and grid.ticks == plan["rows"]
        write_slices(df, f"{path}/data", plan["rows_per_slice"], plan["n_files"], time, grid if whole else None)
    else:
        write_parts(df, f"{path}/data", chosen, plan["n_files"], time)
    n_files = count_files(df.sparkSession, f"{path}/data")
    write_manifest(df.sparkSession, f"{path}/meta", streams, axes or {}, start, end, n_files, plan["rows"])
    return ExportResult(path, n_files, plan["rows"], "completed", FINISHED)


def count_files(spark, path: str) -> int:
    """Data files below ``path``; only their names are listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    return listed.load(path).select("path").count()


def write_parts(df: DataFrame, path: str, kind: str, n_files: int, time: str = "time") -> None:
    """Time-ordered CSV (with header) or JSON parts; part order is time order."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = tied.repartitionByRange(n_files, time, "_tie").sortWithinPartitions(time, "_tie").drop("_tie")
    writer = parts.write.mode("overwrite")
    if kind == "csv":
        # Quotes are doubled inside quotes, which is what other readers expect.
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)


def write_slices(
    df: DataFrame, path: str, rows_per_slice: int, n_files: int, time: str = "time", grid: Grid | None = None
) -> None:
    """Contiguous slices of ``rows_per_slice`` rows in time order, one file each.

    The slice of a row is known before rows move: on a ``grid`` that has one row for
    each tick it is that of the tick, else ``with_slices`` finds it. Rows then go straight to
    the task that writes their slice, in one exchange.
    """
    if grid is None:
        sliced = with_slices(df, time, rows_per_slice)
    else:
        tick = F.call_function("div", to_micros(F.col(time)) - F.lit(grid.start), F.lit(grid.step * rows_per_slice))
        sliced = df.withColumn("slice_id", tick)
    placed = sliced.repartitionById(n_files, F.col("slice_id").cast("int")).sortWithinPartitions("slice_id", time)
    placed.write.mode("overwrite").partitionBy("slice_id").parquet(path)


def write_manifest(spark, path, streams, axes, start, end, n_files, n_rows) -> None:
    row = (list(streams), dict(axes), start, end, n_files, n_rows)
    schema = (
        "reference_designators array<string>, axis_parameters map<string,string>, "
        "start_datetime string, end_datetime string, n_files bigint, n_rows bigint"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def _result_folder(path: str, request_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", request_id):
        raise ValueError("a request id consists of letters, digits, dots, dashes and underscores")
    return f"{path}/request_id={request_id}"


def write_result(df: DataFrame, path: str, request_id: str) -> None:
    """Store the result of a request in a folder of its own, with its own columns."""
    df.write.mode("overwrite").parquet(_result_folder(path, request_id))


def read_result(spark, path: str, request_id: str) -> DataFrame:
    """The result of one request; no other result is listed or read."""
    return spark.read.parquet(_result_folder(path, request_id))


