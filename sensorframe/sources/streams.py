"""Stored streams: handle, reader and writer, manifest and catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.values import fixed_width, nans_to_null, value_bytes
from sensorframe.operators.select import check_dimensions, project, range_bounds, select_ranges
from sensorframe.sources.statistics import StreamStatistics, observed, order_of, read_statistics, write_statistics

DAY = "stream_day"


@dataclass(frozen=True)
class Stream:
    """One stored stream. Every step returns a new handle over a lazy DataFrame."""

    name: str
    base: DataFrame
    dims: tuple[str, ...] = ("time",)
    attrs: Mapping[str, str] = field(default_factory=dict)
    time_ordered: bool = False
    current: DataFrame | None = None
    #: Column of day folders, if the table lies in some.
    day: str | None = None
    #: What was recorded of the whole stream when it was written.
    statistics: StreamStatistics | None = None

    @property
    def df(self) -> DataFrame:
        """The current rows, without the column that names their folder."""
        return self._rows().drop(self.day) if self.day else self._rows()

    def project(self, names: Sequence[str]) -> Stream:
        hidden = ("_pos", self.day) if self.day else ("_pos",)
        return replace(self, current=project(self._rows(), names, keep=hidden))

    def select(self, mode: str = "reference", **ranges) -> Stream:
        check_dimensions(list(ranges), self.dims)
        ordered = ["time"] if self.time_ordered else []
        rows = self._rows()
        if self.day and self.time_ordered and ranges.get("time") is not None:
            # The days of the range prune the folders before any file is opened.
            low, high = (F.to_date(b) for b in range_bounds(ranges["time"]))
            rows = rows.where(F.col(self.day).between(low, high))
        return replace(self, current=select_ranges(rows, ranges, mode, ordered=ordered))

    def _rows(self) -> DataFrame:
        return self.base if self.current is None else self.current

    def reset(self) -> Stream:
        return replace(self, current=None)

    def preview(self) -> DataFrame:
        """One row per variable of the current columns (see ``profile_variables``)."""
        return profile_variables(self.df.withColumn("stream", F.lit(self.name)))


def open_stream(
    spark: SparkSession,
    root: str,
    name: str,
    dims: Sequence[str] = ("time",),
    attrs: Mapping[str, str] | None = None,
    time_ordered: bool | None = None,
) -> Stream:
    """A stream stored as a Parquet table under ``root``, NaN read as null.

    Its statistics are read with it, if it was written with some; they also tell whether
    positions grow with time, unless ``time_ordered`` does.
    """
    table = nans_to_null(spark.read.parquet(f"{root}/{name}"))
    known = read_statistics(spark, f"{root}/{name}")
    if time_ordered is None:
        time_ordered = known is not None and known.ordered
    day = DAY if DAY in table.columns else None
    return Stream(name, table, tuple(dims), dict(attrs or {}), time_ordered, day=day, statistics=known)


def write_stream(samples: DataFrame, root: str, name: str, time: str = "time", statistics: bool = True) -> None:
    """Store a stream in day folders, sorted, so that a time range prunes files and row groups.

    Range partitions keep the number of files per day small and cut a day with
    many samples into several; ties are split by input position. Rows, extent and sizes are observed
    as the rows are written; the order is checked on the written times and positions.
    """
    spark, path = samples.sparkSession, f"{root}/{name}"
    days = samples.withColumn(DAY, F.to_date(time)).withColumn("_tie", F.monotonically_increasing_id())
    placed = days.repartitionByRange(DAY, time, "_tie").sortWithinPartitions(DAY, time, "_tie").drop("_tie")
    if not statistics:
        placed.write.mode("overwrite").partitionBy(DAY).parquet(path)
        return
    # What readers see: NaN is null.
    fields = samples.schema.fields
    watched, seen = observed(nans_to_null(placed), fields, time)
    watched.write.mode("overwrite").partitionBy(DAY).parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    ordered, unique = order_of(stored, time, "_pos" if "_pos" in samples.columns else None)
    write_statistics(spark, path, fields, seen.get, ordered, unique)


def split_stream(samples: DataFrame, stream: str, tag: str = "stream", **handle) -> Stream:
    """A stream held as the rows of a common table."""
    return Stream(stream, samples.where(F.col(tag) == stream).drop(tag), **handle)


def build_manifest(
    samples: DataFrame,
    by: str = "stream",
    dims: Mapping[str, Sequence[str]] | None = None,
    attrs: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """One row per stream and variable: dimensions, attributes, type, counts and bytes.

    A scalar variable lies along ``time``; an array one along ``time`` and
    ``<variable>_index`` unless ``dims`` says otherwise.
    """
    fields = [f for f in samples.schema if f.name not in (by, "_pos")]
    totals, rows = [F.count(F.lit(1)).alias("_rows")], []
    for f in fields:
        is_array = isinstance(f.dataType, T.ArrayType)
        if is_array:
            totals.append(F.sum(F.coalesce(F.size(f.name), F.lit(0)).cast("bigint")).alias(f"_n_{f.name}"))
        totals.append(F.sum(value_bytes(f)).alias(f"_b_{f.name}"))
        along = (dims or {}).get(f.name, ["time", f"{f.name}_index"] if is_array else ["time"])
        item = f.dataType.elementType if is_array else f.dataType
        notes = [F.lit(t) for pair in (attrs or {}).get(f.name, {}).items() for t in pair]
        rows.append(
            F.struct(
                F.lit(f.name).alias("variable"),
                F.array(*[F.lit(d) for d in along]).alias("dims"),
                (F.create_map(*notes) if notes else F.create_map()).cast("map<string,string>").alias("attrs"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(None if isinstance(item, T.StringType) else fixed_width(item)).cast("int").alias("item_bytes"),
                F.col(f"_n_{f.name}" if is_array else "_rows").alias("n_values"),
                F.col(f"_b_{f.name}").alias("n_bytes"),
                F.lit(f.name in along).alias("is_dim"),
            )
        )
    counted = samples.groupBy(by).agg(*totals)
    return counted.select(F.col(by).alias("stream"), F.explode(F.array(*rows)).alias("v")).select("stream", "v.*")


def recorded_manifest(spark: SparkSession, streams: Mapping[str, Stream]) -> DataFrame:
    """``build_manifest`` of stored streams from their statistics; no sample is read."""
    rows = []
    for name, stream in streams.items():
        if stream.statistics is None:
            raise ValueError(f"stream '{name}' was written without statistics")
        kinds = {f.name: f.dataType for f in stream.base.schema}
        for v in stream.statistics.variables:
            if v.variable == "_pos":
                continue
            kind = kinds[v.variable]
            is_array = isinstance(kind, T.ArrayType)
            item = kind.elementType if is_array else kind
            along = ["time", f"{v.variable}_index"] if is_array else ["time"]
            width = None if isinstance(item, T.StringType) else fixed_width(item)
            rows.append((name, v.variable, along, {}, v.dtype, width, v.n_values, v.n_bytes, v.variable in along))
    schema = (
        "stream string, variable string, dims array<string>, attrs map<string,string>, dtype string, "
        "item_bytes int, n_values bigint, n_bytes bigint, is_dim boolean"
    )
    return spark.createDataFrame(rows, schema)


def catalog_names(manifest: DataFrame) -> DataFrame:
    return manifest.select("stream").distinct()


def catalog(manifest: DataFrame) -> DataFrame:
    """One row per stream with its variables, dimensions and size.

    The lists hold one entry per variable of a stream, never one per sample.
    """
    return manifest.groupBy("stream").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_dim"), F.col("variable")))).alias("variables"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dims")))).alias("dims"),
        F.max("n_values").alias("n_values"),
        F.sum("n_bytes").alias("n_bytes"),
    )


def dimension_split(manifest: DataFrame) -> DataFrame:
    """Dimensions and data variables of every stream, with the dims of each variable."""
    is_dim = F.array_contains("dims", F.col("variable"))
    return manifest.select("stream", "variable", "dims", is_dim.alias("is_dim"))


def describe_stream(manifest: DataFrame, name: str) -> DataFrame:
    found = manifest.where(F.col("stream") == name)
    if not found.take(1):
        raise ValueError(f"no data stream named '{name}' in the catalog")
    return found


def profile_variables(samples: DataFrame, by: str = "stream") -> DataFrame:
    """One row per stream and variable: type, counts, extremes as text, bytes."""
    fields = [f for f in samples.schema if f.name not in (by, "_pos")]
    totals, rows = [F.count(F.lit(1)).alias("_rows")], []
    for f in fields:
        n = f.name
        totals += [F.count(n).alias(f"_c_{n}"), F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}")]
        totals.append(F.sum(value_bytes(f)).alias(f"_b_{n}"))
        rows.append(
            F.struct(
                F.lit(n).alias("variable"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"_c_{n}").alias("n_values"),
                (F.col("_rows") - F.col(f"_c_{n}")).alias("n_nulls"),
                F.col(f"_lo_{n}").cast("string").alias("low"),
                F.col(f"_hi_{n}").cast("string").alias("high"),
                F.col(f"_b_{n}").alias("n_bytes"),
            )
        )
    counted = samples.groupBy(by).agg(*totals)
    return counted.select(F.col(by).alias("stream"), F.explode(F.array(*rows)).alias("v")).select("stream", "v.*")
