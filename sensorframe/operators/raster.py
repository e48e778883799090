"""Mean-aggregated pixel raster and the plot projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.cftime import from_micros, to_micros
from sensorframe.functions.values import nan_to_null

# Canvas in pixels and the row count above which a plot is rasterised.
CANVAS = (888, 450)
SHADE_THRESHOLD = 500_000


@dataclass(frozen=True)
class Bounds:
    x_low: float
    x_high: float
    y_low: float
    y_high: float


def as_number(df: DataFrame, name: str) -> Column:
    """An axis as a double, NaN as null; timestamps count in microseconds."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return to_micros(F.col(name)).cast("double")
    return nan_to_null(F.col(name).cast("double"))


def bounds_struct(df: DataFrame, x: str, y: str) -> Column:
    """Aggregate: the data range of both axes."""
    xs, ys = as_number(df, x), as_number(df, y)
    return F.struct(
        F.min(xs).alias("x_low"), F.max(xs).alias("x_high"), F.min(ys).alias("y_low"), F.max(ys).alias("y_high")
    )


def rasterize(
    points: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    canvas: tuple[int, int] = CANVAS,
    bounds: Bounds | None = None,
    dense: bool = False,
) -> DataFrame:
    """Mean of ``color`` (``y`` without one) per pixel of a canvas over the data range.

    Columns ``px, py, x_center, y_center, value, n``. Without ``bounds`` they
    come from a scalar subquery; with them, points outside are left out. The result never exceeds the canvas, and the
    partial aggregation keeps what is shuffled within it per task. ``dense``
    also returns the empty pixels, with a null value.
    """
    width, height = canvas
    if bounds is None:
        found = points.agg(bounds_struct(points, x, y).alias("bounds")).scalar()
        edge = {k: found[k] for k in ("x_low", "x_high", "y_low", "y_high")}
    else:
        edge = {k: F.lit(v) for k, v in vars(bounds).items()}
    xs, ys = as_number(points, x), as_number(points, y)
    value = as_number(points, color or y)
    # Points outside given bounds lie on no pixel; a null or NaN axis value lies nowhere.
    inside = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    if bounds is not None:
        inside = F.col("_x").between(edge["x_low"], edge["x_high"]) & F.col("_y").between(edge["y_low"], edge["y_high"])
    pixels = (
        points.select(xs.alias("_x"), ys.alias("_y"), value.alias("_value"))
        .where(inside)
        .groupBy(
            _cell(F.col("_x"), edge["x_low"], edge["x_high"], width).alias("px"),
            _cell(F.col("_y"), edge["y_low"], edge["y_high"], height).alias("py"),
        )
        .agg(F.avg("_value").alias("value"), F.count(F.lit(1)).alias("n"))
    )
    if dense:
        canvas_rows = points.sparkSession.range(width * height).select(
            F.pmod(F.col("id"), F.lit(width)).cast("int").alias("px"),
            F.floor(F.col("id") / F.lit(width)).cast("int").alias("py"),
        )
        pixels = canvas_rows.join(pixels, ["px", "py"], "left").withColumn(
            "n", F.coalesce("n", F.lit(0).cast("bigint"))
        )
    x_center = _center(F.col("px"), edge["x_low"], edge["x_high"], width)
    y_center = _center(F.col("py"), edge["y_low"], edge["y_high"], height)
    return pixels.select(
        "px",
        "py",
        _like_axis(points, x, x_center).alias("x_center"),
        _like_axis(points, y, y_center).alias("y_center"),
        "value",
        "n",
    )


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    scaled = F.floor((v - low) * F.lit(cells) / (high - low)).cast("int")
    return F.when(high > low, F.least(scaled, F.lit(cells - 1))).otherwise(F.lit(0))


def _center(cell: Column, low: Column, high: Column, cells: int) -> Column:
    return low + (cell + F.lit(0.5)) * (high - low) / F.lit(cells)


def _like_axis(df: DataFrame, name: str, center: Column) -> Column:
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return from_micros(F.round(center).cast("bigint"))
    return center
