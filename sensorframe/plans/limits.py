"""Export planning: part counts, slice plans and their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Part sizes in bytes (decimal megabytes), and the most files of an export where a caller asks for a limit.
SLICE_BYTES = 100_000_000
CSV_PART_BYTES = 10_000_000
MAX_FILES = 50

# What a request is answered with.
FINISHED = "Result finished."
NO_DATA = "No data found for {start} to {end}"
TOO_LARGE = "Max dimension size of {size} is too large at this time"
NOT_COVERED = "One of the dataset does not contain data."
EMPTY_STREAMS = "Empty data stream(s) found: {streams}."
UNKNOWN_FORMAT = "Request failed: unknown format {kind}"
MERGED_EMPTY = "Merged dataset does not contain data."
REFUSED = "The amount of data to be downloaded is too large for {kind} data format. Please make a smaller request."


def csv_parts(size: Column, part_bytes: int | None = None) -> Column:
    """Parts of a CSV or JSON export; at least one."""
    parts = F.ceil(size / F.lit(part_bytes or CSV_PART_BYTES)).cast("bigint")
    return F.greatest(parts, F.lit(1).cast("bigint"))


def rows_per_slice(rows: Column, size: Column, slice_bytes: int | None = None) -> Column:
    """Rows of one slice, rounded up, so that a slice holds about ``slice_bytes``."""
    return F.ceil(rows / F.nullif(size / F.lit(slice_bytes or SLICE_BYTES), F.lit(0.0))).cast("bigint")


def slice_count(rows: Column, size: Column, slice_bytes: int | None = None) -> Column:
    return F.ceil(rows / rows_per_slice(rows, size, slice_bytes)).cast("bigint")


def plan_slices(
    sizes: DataFrame,
    slice_bytes: int = SLICE_BYTES,
    max_files: int | None = None,
    rows: str = "rows",
    size: str = "size",
) -> DataFrame:
    """Add ``rows_per_slice``, ``n_files``, ``allowed`` and ``layout``; nothing is refused without ``max_files``."""
    planned = sizes.withColumn("rows_per_slice", rows_per_slice(F.col(rows), F.col(size), slice_bytes))
    planned = planned.withColumn("n_files", F.ceil(F.col(rows) / F.col("rows_per_slice")).cast("bigint"))
    layout = (
        F.when(~_allowed(max_files), F.lit("refused"))
        .when(F.col("n_files") == 1, F.lit("file"))
        .otherwise(F.lit("folder"))
    )
    return planned.withColumns({"allowed": _allowed(max_files), "layout": layout})


def _allowed(max_files: int | None) -> Column:
    return F.lit(True) if max_files is None else F.coalesce(F.col("n_files") <= max_files, F.lit(True))


def slice_bounds(planned: DataFrame, rows: str = "rows") -> DataFrame:
    """One row per slice: ``slice_id, start_row, end_row`` (the last may reach past the data)."""
    keep = [c for c in planned.columns if c not in ("rows_per_slice", "n_files", "allowed", "layout")]
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_files") - 1)).alias("slice_id")
    step = F.col("rows_per_slice")
    return planned.select(*keep, "rows_per_slice", ids).select(
        *keep,
        "slice_id",
        (F.col("slice_id") * step).alias("start_row"),
        ((F.col("slice_id") + 1) * step).alias("end_row"),
    )


def plan_csv(
    sizes: DataFrame, part_bytes: int = CSV_PART_BYTES, max_files: int | None = None, size: str = "size"
) -> DataFrame:
    """Add ``n_files``, ``allowed`` and ``msg``; nothing is refused without ``max_files``."""
    planned = sizes.withColumn("n_files", csv_parts(F.col(size), part_bytes))
    allowed = _allowed(max_files)
    return planned.withColumns({"allowed": allowed, "msg": F.when(~allowed, F.lit(REFUSED.format(kind="CSV")))})
