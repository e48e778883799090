"""Null, type and size functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-data marker of the sample files, as number and as text.
SENTINEL = -9999999.0
SENTINEL_TEXT = ("-9999999", "-9999999.0")

# Cell texts that common CSV readers take as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: the shape of a number; a cast alone would take "5f" and "1d" for numbers.
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?[iI]nf(inity)?$"

SIZE_UNITS = ("bytes", "KB", "MB", "GB", "TB")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def nans_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every float and double column; other columns pass unchanged."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def text_sentinel_to_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TEXT, *SENTINEL_TEXT), value)


def number_sentinel_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(SENTINEL))


def to_measurement(text: Column) -> Column:
    """Text to double; text that is no number, NaN and the sentinel become null."""
    return number_sentinel_to_null(F.when(is_number(text), F.trim(text).try_cast("double")))


def is_number(text: Column) -> Column:
    return F.trim(text).rlike(NUMBER_SHAPE)


def first_sensor(primary: Column, secondary: Column) -> Column:
    return F.coalesce(primary, secondary)


def size_text(size: Column) -> Column:
    """Bytes as readable text in steps of 1024, one decimal (``1.5 MB``)."""
    text = F.lit(None).cast("string")
    for power in reversed(range(len(SIZE_UNITS))):
        scaled = F.bround(size.cast("double") / F.lit(float(1024**power)), 1)
        shown = F.format_string(f"%.1f {SIZE_UNITS[power]}", scaled)
        text = shown if power == len(SIZE_UNITS) - 1 else F.when(size < 1024 ** (power + 1), shown).otherwise(text)
    return F.when(size.isNotNull(), text)


def readable_size(size: int) -> str:
    """``size_text`` of one number."""
    power = next((p for p in range(len(SIZE_UNITS) - 1) if size < 1024 ** (p + 1)), len(SIZE_UNITS) - 1)
    return f"{round(size / 1024**power, 1):.1f} {SIZE_UNITS[power]}"


def fingerprint(fields: Sequence[str]) -> Column:
    """md5 over the JSON of the named columns in the given order."""
    return F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def value_bytes(field: T.StructField) -> Column:
    """Stored bytes of one value of a column: fixed width, text length, or array sum."""
    kind, col = field.dataType, F.col(field.name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(col), F.lit(0)).cast("bigint") * fixed_width(kind.elementType)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint")
    return F.lit(fixed_width(kind)).cast("bigint")


def fixed_width(kind: T.DataType) -> int:
    widths = {
        T.BooleanType: 1,
        T.ByteType: 1,
        T.ShortType: 2,
        T.IntegerType: 4,
        T.FloatType: 4,
        T.DateType: 4,
    }
    return widths.get(type(kind), 8)
