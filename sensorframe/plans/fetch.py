"""A request over stored streams, from its text fields to a plot or an export."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.values import readable_size, value_bytes
from sensorframe.operators.merge import tagged_union, union_by_name
from sensorframe.operators.resample import ONE_DAY, ONE_SECOND, Grid, align
from sensorframe.operators.select import axis_columns, spans_meet
from sensorframe.plans.export import EXPORT_FORMATS, ExportResult, export
from sensorframe.plans.limits import EMPTY_STREAMS, NOT_COVERED, TOO_LARGE, UNKNOWN_FORMAT
from sensorframe.plans.plot import PlotResult, plot
from sensorframe.plans.requests import REQUEST_DEFAULTS
from sensorframe.session import materialize
from sensorframe.sources.streams import Stream

@dataclass(frozen=True)
class Prepared:
    """The merged rows of a request, or why there are none."""

    merged: DataFrame | None
    msg: str = ""
    status: str = "completed"
    #: The grid of several merged streams: one row for each tick.
    grid: Grid | None = None
    #: Looks why the merged rows turned out to be none.
    empty_reason: Callable[[], Prepared | None] | None = None

    def reason(self) -> Prepared | None:
        return self.empty_reason() if self.empty_reason is not None else None


def select_streams(
    streams: Mapping[str, Stream], x: str, y: str, color: str, start: str, end: str, mode: str = "reference"
) -> dict[str, DataFrame]:
    """Every stream cut to the wanted columns and the time range."""
    wanted = axis_columns(x, y, color)
    return {name: s.project(wanted).select(mode, time=(start, end)).df for name, s in streams.items()}


def merge_selected(
    selected: Mapping[str, DataFrame],
    start: str,
    end: str,
    step: timedelta = ONE_SECOND,
    max_gap: timedelta = ONE_DAY,
    suffix: bool = False,
    duplicates: str = "error",
) -> DataFrame:
    """One stream passes through as it is; several are resampled and merged on time.

    Positions order the samples of an instant where ``duplicates`` asks for an order.
    """
    if len(selected) == 1:
        (only,) = selected.values()
        return only.drop("_pos")
    position = "_pos" if duplicates in ("first", "all") else None
    samples = tagged_union({name: df if position else df.drop("_pos") for name, df in selected.items()}, "stream")
    return align(
        samples, start, end, step, max_gap=max_gap, duplicates=duplicates, position=position, streams=list(selected), suffix=suffix
    )


def uncovered_streams(streams: Mapping[str, Stream], start, end, mode: str = "reference") -> list[str]:
    """Names of the streams that do not cover the request.

    Recorded extents decide without a job; the extents of streams without a record are
    scanned in one, with one row per stream.
    """
    known, scanned = {}, []
    for name, s in streams.items():
        if s.statistics is not None:
            known[name] = (s.statistics.first_time, s.statistics.last_time)
        else:
            scanned.append(s.base.agg(F.min("time").alias("a"), F.max("time").alias("b")).withColumn("stream", F.lit(name)))
    if scanned:
        known |= {r["stream"]: (r["a"], r["b"]) for r in union_by_name(scanned).collect()}
    return sorted(n for n, (a, b) in known.items() if not spans_meet(start, end, a, b, mode))


def _present(frames: Mapping[str, DataFrame]) -> set[str]:
    """Names of the frames with at least one row; one job."""
    if not frames:
        return set()
    tagged = union_by_name([df.limit(1).select(F.lit(name).alias("stream")) for name, df in frames.items()])
    return {r["stream"] for r in tagged.collect()}


def prepare(
    streams: Mapping[str, Stream],
    x: str,
    y: str,
    start: str,
    end: str,
    color: str = "",
    step: timedelta = ONE_SECOND,
    suffix: bool = False,
    max_dimension_bytes: int | None = None,
    duplicates: str | None = None,
) -> Prepared:
    """Admission (only with ``max_dimension_bytes``), coverage and emptiness checks, then selection and merge.

    ``duplicates`` is that of ``resample``; without one, several samples of one instant are an
    error unless the records of the streams tell that there are none.

    Sizes and coverage come from the records of stored streams. A single stream is not looked
    into here: only if its result turns out empty does ``Prepared.reason`` look why.
    A merge of several streams is stored, as every result reads it more than once.
    """
    if max_dimension_bytes is not None:
        dimensions = dimension_size(streams)
        if dimensions.size > max_dimension_bytes:
            return Prepared(None, TOO_LARGE.format(size=dimensions.text))
    missing = set(uncovered_streams(streams, start, end))
    within = {name: s for name, s in streams.items() if name not in missing}
    selected = select_streams(within, x, y, color, start, end)

    def empty_reason(empty: list[str]) -> Prepared | None:
        """Why streams without a selected row have none, and what else stands in the way."""
        matched = _present(select_streams({n: streams[n] for n in empty}, x, y, color, start, end, "inclusive"))
        unmatched = [name for name in empty if name not in matched]
        if unmatched:
            return Prepared(None, f"No sample of {','.join(unmatched)} lies between {start} and {end}.", "failed")
        if missing:
            return Prepared(None, NOT_COVERED)
        return Prepared(None, EMPTY_STREAMS.format(streams=",".join(empty))) if empty else None

    if len(streams) == 1 and not missing:
        return Prepared(selected[next(iter(streams))].drop("_pos"), empty_reason=lambda: empty_reason(list(streams)))
    present = _present(selected)
    reason = empty_reason([name for name in within if name not in present])
    if reason is not None:
        return reason
    unique = all(s.statistics is not None and s.statistics.unique for s in streams.values())
    merged = merge_selected(selected, start, end, step, suffix=suffix, duplicates="unique" if unique else duplicates or "error")
    return Prepared(materialize(merged), grid=Grid.of(start, end, step))


@dataclass(frozen=True)
class DimensionSize:
    size: int
    text: str


def dimension_size(streams: Mapping[str, Stream]) -> DimensionSize:
    """``size`` in bytes, and as ``text``, of all dimension coordinates of whole streams.

    Taken from the records of stored streams; of others only those columns are read.
    """
    size, scanned = 0, []
    for stream in streams.values():
        if stream.statistics is not None:
            size += stream.statistics.bytes_of(stream.dims)
            continue
        fields = [f for f in stream.base.schema if f.name in stream.dims]
        width = sum((value_bytes(f) for f in fields), F.lit(0).cast("bigint"))
        scanned.append(stream.base.agg(F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("n")))
    if scanned:
        size += union_by_name(scanned).agg(F.sum("n").alias("size")).first()["size"]
    return DimensionSize(size, readable_size(size))


def plot_request(
    streams: Mapping[str, Stream],
    x: str,
    y: str,
    start: str,
    end: str,
    color: str = "",
    max_dimension_bytes: int | None = None,
    duplicates: str | None = None,
    **options,
) -> PlotResult:
    """``options`` go to ``plot``."""
    ready = prepare(streams, x, y, start, end, color, max_dimension_bytes=max_dimension_bytes, duplicates=duplicates)
    if ready.merged is None:
        return PlotResult(None, 0, False, ready.msg, ready.status)
    result = plot(ready.merged, x, y, color, **options)
    why = ready.reason() if result.count == 0 else None
    return result if why is None else PlotResult(None, 0, False, why.msg, why.status)


def download_request(
    streams: Mapping[str, Stream],
    x: str,
    y: str,
    start: str,
    end: str,
    root: str,
    color: str = "",
    download_format: str = "netcdf",
    max_dimension_bytes: int | None = None,
    duplicates: str | None = None,
    **options,
) -> ExportResult:
    """``options`` go to ``export``. A format that is not on offer fails before anything is read."""
    if (download_format or "netcdf") not in EXPORT_FORMATS:
        return ExportResult(None, 0, 0, "failed", UNKNOWN_FORMAT.format(kind=download_format))
    ready = prepare(streams, x, y, start, end, color, max_dimension_bytes=max_dimension_bytes, duplicates=duplicates)
    if ready.merged is None:
        return ExportResult(None, 0, 0, ready.status, ready.msg)
    axes = {"x": x, "y": y, "z": color}
    result = export(ready.merged, root, start, end, download_format, list(streams), axes, grid=ready.grid, **options)
    why = ready.reason() if result.n_rows == 0 else None
    return result if why is None else ExportResult(None, 0, 0, why.status, why.msg)


def fetch(
    request: Mapping, catalog: Mapping[str, Stream], root: str | None = None, **options
) -> PlotResult | ExportResult:
    """Run one request given by its fields; ``catalog`` finds the streams, ``root`` takes downloads.

    Limits are the caller's choice: ``max_dimension_bytes`` for both kinds, ``shade_threshold``
    for plots, ``max_files`` and ``part_bytes`` for downloads. So is what several samples of one
    instant mean where streams are merged: ``duplicates`` (see ``prepare``).
    """
    fields = {**REQUEST_DEFAULTS, **request}
    names = list(dict.fromkeys(fields["ref"].split(",")))
    unknown = [n for n in names if n not in catalog]
    if unknown:
        raise ValueError(f"no data stream named {', '.join(unknown)} in the catalog")
    streams = {n: catalog[n] for n in names}
    where = (streams, fields["x"], fields["y"], fields["start_dt"], fields["end_dt"])
    if not fields["download"]:
        return plot_request(*where, fields["color"], **options)
    if root is None:
        raise ValueError("a download needs a folder to write to")
    return download_request(*where, root, fields["color"], fields["download_format"], **options)
