"""Cleaning of cruise-sample rows: sentinels, times, types, empty rows and columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.cftime import parse_datetime
from sensorframe.functions.values import is_number, number_sentinel_to_null, text_sentinel_to_null, to_measurement
from sensorframe.operators.joins import sized_join

# Name parts that mark measurement columns, and parts that exempt them.
MEASUREMENT_PARTS = ("ctd", "discrete", "calculated")
TEXT_PARTS = ("file", "bottle_closure_time")


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def measurement_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(p in n for p in MEASUREMENT_PARTS) and not any(p in n for p in TEXT_PARTS)]


def time_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if "time" in n]


def drop_empty_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Without the rows that are null in every column (tags in ``ignore`` do not count)."""
    return df.dropna("all", subset=[c for c in df.columns if c not in ignore])


def null_sentinels(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """The missing-data marker, as number or text, to null in every column."""

    def cleaned(name: str) -> Column:
        kind = df.schema[name].dataType
        if name in ignore:
            return F.col(name)
        if isinstance(kind, T.StringType):
            return text_sentinel_to_null(F.col(name)).alias(name)
        if isinstance(kind, T.NumericType):
            return number_sentinel_to_null(F.col(name)).alias(name)
        return F.col(name)

    return df.select([cleaned(c) for c in df.columns])


def require_column(df: DataFrame, name: str = "cruise") -> DataFrame:
    return df.dropna(subset=[name])


def parse_times(df: DataFrame) -> DataFrame:
    """Parse every time column; rows with a missing or unreadable time are dropped."""
    names = time_columns(df.columns)
    parsed = df.withColumns({n: parse_datetime(F.col(n)) for n in names if is_text(df, n)})
    return parsed.dropna("any", subset=names) if names else parsed


def cast_measurements(df: DataFrame, strict: bool = False, by: Sequence[str] = ("cruise_id",)) -> DataFrame:
    """Measurement columns to double; values that are no number become null.

    ``strict``: a column with any such value becomes null as a whole within its
    group of ``by`` (one source file).
    """
    names = [n for n in measurement_columns(df.columns) if is_text(df, n)]
    if not names:
        return df
    out = df
    if strict:
        spoiled = df.groupBy(*by).agg(*[F.bool_or(is_invalid(F.col(n))).alias(f"_bad_{n}") for n in names])
        out = sized_join(df, spoiled, by, "left", costly=True)
    casts = {}
    for n in names:
        value = to_measurement(F.col(n))
        casts[n] = F.when(~F.coalesce(F.col(f"_bad_{n}"), F.lit(False)), value) if strict else value
    return out.withColumns(casts).select(*df.columns)


def is_invalid(text: Column) -> Column:
    """Text in a measurement column that is not missing and not a number."""
    return text_sentinel_to_null(text).isNotNull() & ~is_number(text)


def invalid_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quality report: every distinct invalid value per measurement column, with its count.

    One row per value, so a column with many of them needs no long list.
    """
    names = [n for n in (columns or measurement_columns(df.columns)) if is_text(df, n)]
    found = [
        F.when(is_invalid(F.col(n)), F.struct(F.lit(n).alias("column"), F.col(n).alias("invalid_value"))) for n in names
    ]
    values = df.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")
    return values.groupBy("column", "invalid_value").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def empty_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Which of the named columns hold no value at all (one aggregation, one row back)."""
    present = [n for n in names if n in df.columns]
    if not present:
        return []
    counts = df.agg(*[F.count(n).alias(n) for n in present]).first()
    return [n for n in present if counts[n] == 0]


def drop_empty_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*empty_columns(df, names))


def columns_matching(names: Sequence[str], include: str, *exclude: str) -> list[str]:
    return [n for n in names if re.search(include, n) and not any(re.search(e, n) for e in exclude)]
