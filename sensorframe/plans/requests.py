"""Request batches: expansion, keys, size estimate, admission and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.cftime import bound_column, parse_datetime, to_micros
from sensorframe.functions.values import fingerprint, size_text
from sensorframe.operators.joins import join_on_keys
from sensorframe.operators.ranks import range_counts
from sensorframe.operators.select import axis_columns_of, coverage, stream_extents
from sensorframe.plans.export import EXPORT_FORMATS
from sensorframe.plans.limits import FINISHED, NO_DATA, REFUSED, csv_parts, slice_count

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("ref", T.StringType(), False),
        T.StructField("x", T.StringType(), False),
        T.StructField("y", T.StringType(), False),
        T.StructField("start_dt", T.StringType(), False),
        T.StructField("end_dt", T.StringType(), False),
        T.StructField("z", T.StringType(), True),
        T.StructField("color", T.StringType(), True),
        T.StructField("download_format", T.StringType(), True),
        T.StructField("download", T.BooleanType(), True),
    ]
)
# What a request leaves out, and the dimension limit where a caller asks for one.
REQUEST_DEFAULTS = {"z": "", "color": "", "download_format": "netcdf", "download": False}
MAX_DIMENSION_BYTES = 15 * 1024**3


def with_defaults(requests: DataFrame) -> DataFrame:
    missing = {n: F.lit(v) for n, v in REQUEST_DEFAULTS.items() if n not in requests.columns}
    return requests.withColumns(missing).fillna(REQUEST_DEFAULTS)


def with_request_id(requests: DataFrame) -> DataFrame:
    """Defaults filled and ``request_id``, equal for requests equal in every field."""
    return with_defaults(requests).withColumn("request_id", fingerprint(REQUEST_SCHEMA.names))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    return with_request_id(requests).dropDuplicates(["request_id"])


def expand_requests(requests: DataFrame) -> DataFrame:
    """One row per request and distinct stream, with parsed bounds and wanted columns."""
    return requests.select(
        "request_id",
        F.explode(F.array_distinct(F.split("ref", ","))).alias("stream"),
        "x",
        "y",
        "color",
        axis_columns_of(F.col("x"), F.col("y"), F.col("color")).alias("wanted"),
        parse_datetime(F.col("start_dt")).alias("start"),
        parse_datetime(F.col("end_dt")).alias("end"),
    )


def stream_sizes(expanded: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per request and stream: bytes of the wanted variables and of all dimension coordinates.

    Sizes are those of the whole stream, before any range is cut. ``known`` is
    false for a stream the manifest lacks.
    """
    joined = join_on_keys(expanded.select("request_id", "stream", "wanted"), manifest, ["stream"])
    wanted = F.array_contains("wanted", F.col("variable"))
    width = F.coalesce(F.col("n_bytes") / F.col("n_values"), F.lit(0.0))
    return joined.groupBy("request_id", "stream").agg(
        (F.count("variable") > 0).alias("known"),
        F.coalesce(F.sum(F.when(wanted, F.col("n_bytes"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum(F.when(F.col("is_dim"), F.col("n_bytes"))), F.lit(0)).alias("total_dim_size"),
        F.coalesce(F.sum(F.when(wanted, width)), F.lit(0.0)).alias("row_bytes"),
    )


def request_totals(sizes: DataFrame, max_dimension_bytes: int | None = None) -> DataFrame:
    """Per request the summed sizes, a readable message and the admission check (if there is a limit)."""
    totals = sizes.groupBy("request_id").agg(
        F.sum("total_size").alias("total_size"), F.sum("total_dim_size").alias("total_dim_size")
    )
    return totals.select(
        "*",
        F.concat(F.lit("Max data request: "), size_text(F.col("total_size"))).alias("msg"),
        (~_too_large(max_dimension_bytes)).alias("admitted"),
    )


def _too_large(max_dimension_bytes: int | None) -> Column:
    return F.lit(False) if max_dimension_bytes is None else F.col("total_dim_size") > max_dimension_bytes


def selected_rows(
    expanded: DataFrame,
    samples: DataFrame,
    time: str = "time",
    position: str = "_pos",
    time_ordered: bool = False,
) -> DataFrame:
    """Per request and stream: matching rows, and rows left by the positional cut.

    The bounds of all requests are ranked in the time order of their stream, and in the
    order of positions for the cut (see ``range_counts``): samples are never joined with
    the requests that cover them. The batch's outer time range is pushed to
    the scan. A stream with no match has no row.
    """
    batch = expanded.select("request_id", "stream", "start", "end")
    span = batch.agg(F.min("start").alias("low"), F.max("end").alias("high")).first()
    rows = samples.select("stream", F.col(time).alias("_time"), F.col(position).cast("bigint").alias("_place"))
    in_span = rows
    if span["low"] is not None and span["high"] is not None:
        in_span = rows.where(F.col("_time").between(bound_column(span["low"]), bound_column(span["high"])))
    bounds = batch.select(
        "request_id", "stream", to_micros(F.col("start")).alias("low"), (to_micros(F.col("end")) + 1).alias("high")
    )
    at = to_micros(F.col("_time"))
    if time_ordered:
        counted = range_counts(bounds, in_span, ["stream"], at, "low", "high").where("n > 0")
        return counted.select("request_id", "stream", F.col("n").alias("n_match"), (F.col("n") - 1).alias("n_rows"))
    counted = range_counts(bounds, in_span, ["stream"], at, "low", "high", F.col("_place")).where("n > 0")
    cuts = counted.select("request_id", "stream", F.col("n").alias("n_match"), "least", "greatest")
    kept = range_counts(cuts, rows, ["stream"], F.col("_place"), "least", "greatest")
    return kept.select("request_id", "stream", "n_match", F.col("n").alias("n_rows"))


def request_outcomes(
    requests: DataFrame,
    samples: DataFrame,
    manifest: DataFrame,
    time_ordered: bool = False,
    max_dimension_bytes: int | None = None,
    max_files: int | None = None,
    part_bytes: dict[str, int] | None = None,
) -> DataFrame:
    """What becomes of every request of a batch; the first rule that applies decides.

    Requests are refused for their size only where a limit is given.

    ``requests`` carries ``request_id`` (see ``with_request_id``).
    """
    expanded = expand_requests(requests)
    covered = coverage(expanded, stream_extents(samples), "reference")
    per_stream = covered.join(stream_sizes(expanded, manifest), ["request_id", "stream"], "left").join(
        selected_rows(expanded, samples, time_ordered=time_ordered), ["request_id", "stream"], "left"
    )
    matches = F.coalesce("n_match", F.lit(0).cast("bigint"))
    rows = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    per_request = per_stream.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_streams"),
        F.bool_or(~F.col("known")).alias("unknown"),
        F.bool_or(F.col("start").isNull() | F.col("end").isNull()).alias("undated"),
        F.sum("total_size").alias("total_size"),
        F.sum("total_dim_size").alias("total_dim_size"),
        F.bool_or(F.col("covered") & (matches == 0)).alias("unmatched"),
        F.bool_or(~F.col("covered")).alias("uncovered"),
        # One entry per stream named in the request text.
        F.array_join(F.array_sort(F.collect_set(F.when(rows == 0, F.col("stream")))), ",").alias("empty_streams"),
        F.sum(rows).alias("n_selected"),
        F.max("row_bytes").alias("row_bytes"),
        F.first("wanted").alias("wanted"),
        F.first("start").alias("start"),
        F.first("end").alias("end"),
    )
    full = requests.select("request_id", "start_dt", "end_dt", "download", "download_format").join(
        per_request, "request_id"
    )
    seconds = (to_micros(F.col("end")) - to_micros(F.col("start"))) / F.lit(1_000_000)
    ticks = F.greatest(F.ceil(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    single = F.col("n_streams") == 1
    merged_bytes = F.when(single, F.col("row_bytes")).otherwise(F.size("wanted") * 8.0)
    sized = full.withColumn("merged_rows", F.when(single, F.col("n_selected")).otherwise(ticks))
    sized = sized.withColumn("merged_bytes", F.round(F.col("merged_rows") * merged_bytes).cast("bigint"))
    return _classify(sized, max_dimension_bytes, max_files, part_bytes or {})


def _classify(sized: DataFrame, max_dimension_bytes: int | None, max_files: int | None, part_bytes: dict[str, int]) -> DataFrame:
    chosen = F.when(F.coalesce("download_format", F.lit("")) == "", F.lit("netcdf")).otherwise(F.col("download_format"))
    n, size = F.col("merged_rows"), F.col("merged_bytes")
    files = (
        F.when(~F.col("download"), F.lit(0).cast("bigint"))
        .when(chosen == "netcdf", slice_count(n, size, part_bytes.get("netcdf")))
        .when(chosen.isin("csv", "json"), csv_parts(size, part_bytes.get("csv")))
    )
    too_many = F.lit(False) if max_files is None else F.col("n_files") > max_files
    ladder = [
        (F.col("unknown"), "failed", "unknown stream"),
        (F.col("undated"), "failed", "unreadable time"),
        (_too_large(max_dimension_bytes), "no data", "too large"),
        (F.col("unmatched"), "failed", "no matching rows"),
        (F.col("uncovered"), "no data", "not covered"),
        (F.col("empty_streams") != "", "no data", "empty streams"),
        (F.col("merged_rows") == 0, "no data", "merged empty"),
        (F.col("download") & too_many, "refused", "too many files"),
        (F.col("download") & ~F.col("format").isin(*EXPORT_FORMATS), "failed", "unknown format"),
        (F.col("download"), "file", "download"),
        (F.lit(True), "plot", "plot"),
    ]
    planned = sized.withColumns({"format": chosen}).withColumn("n_files", files)
    outcome, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, result, why in reversed(ladder):
        outcome = F.when(condition, F.lit(result)).otherwise(outcome)
        reason = F.when(condition, F.lit(why)).otherwise(reason)
    done = planned.withColumns({"outcome": outcome, "reason": reason})
    return done.select(
        "request_id",
        "n_streams",
        "total_size",
        "total_dim_size",
        "empty_streams",
        "merged_rows",
        "merged_bytes",
        "n_files",
        "outcome",
        "reason",
        F.when(F.col("outcome") == "failed", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        _message().alias("msg"),
    )


def _message() -> Column:
    none = F.replace(F.lit(NO_DATA), F.lit("{start}"), F.col("start_dt"))
    none = F.replace(none, F.lit("{end}"), F.col("end_dt"))
    kind = F.when(F.col("format") == "netcdf", F.lit("NetCDF")).otherwise(F.upper("format"))
    refused = F.replace(F.lit(REFUSED), F.lit("{kind}"), kind)
    return (
        F.when(F.col("outcome") == "no data", none)
        .when(F.col("outcome") == "refused", refused)
        .when(F.col("outcome") == "failed", F.concat(F.lit("Request failed: "), F.col("reason")))
        .otherwise(F.lit(FINISHED))
    )
