"""Plots of a merged table: points or a mean raster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.ranges import row_index
from sensorframe.operators.raster import CANVAS, Bounds, bounds_struct, rasterize
from sensorframe.operators.select import plot_points, swap_key
from sensorframe.plans.limits import FINISHED, MERGED_EMPTY


@dataclass(frozen=True)
class PlotResult:
    """``data`` holds points or pixels; ``count`` is the merged rows behind them."""

    data: DataFrame | None
    count: int
    shaded: bool
    msg: str
    status: str = "completed"


def plot(
    merged: DataFrame,
    x: str,
    y: str,
    color: str = "",
    shade_threshold: int | None = None,
    canvas: tuple[int, int] = CANVAS,
) -> PlotResult:
    """Points, or with ``shade_threshold`` a mean raster above that many rows.

    One pass measures rows and axis ranges; they are the only values that come
    to the driver.
    """
    table = merged if x == "time" else swap_key(merged, x)
    found = table.agg(F.count(F.lit(1)).alias("n"), bounds_struct(table, x, y).alias("bounds")).first()
    count = found["n"]
    if count == 0:
        return PlotResult(None, 0, False, MERGED_EMPTY)
    if shade_threshold is None or count <= shade_threshold:
        return PlotResult(plot_points(table, x, y, color), count, False, FINISHED)
    bounds = Bounds(**found["bounds"].asDict())
    pixels = rasterize(table, x, y, color or None, canvas, bounds)
    return PlotResult(pixels.withColumnRenamed("value", color or y), count, True, FINISHED)


def list_pages(result: PlotResult, rows_per_page: int, order_by: Sequence[str]) -> DataFrame:
    """A result as pages of lists: ``page``, and for each column the list of its values, in order.

    Rows are numbered by ``order_by`` over range partitions, ties in an order of their own.
    A page holds ``rows_per_page`` rows, the last one what is left; no value is longer, whatever
    the size of the result.
    """
    if rows_per_page < 1:
        raise ValueError("a page holds at least one row")
    names = result.data.columns
    numbered = row_index(result.data, order_by, "_row")
    page = F.floor(F.col("_row") / F.lit(rows_per_page)).cast("bigint").alias("page")
    packed = numbered.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("_row", *names))).alias("p"))
    return packed.select("page", *[F.col("p")[n].alias(n) for n in names])


def column_lists(result: PlotResult, limit: int | None = None) -> DataFrame:
    """A result as one row of lists, in the order of its columns.

    One row is one value, so the lists are built in one task; ``limit`` refuses
    results with more rows than the caller wants to hold.
    """
    if limit is not None and result.data.count() > limit:
        raise ValueError(f"result has more than {limit} rows")
    names = result.data.columns
    packed = result.data.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("p"))
    return packed.select(*[F.col("p")[n].alias(n) for n in names])
