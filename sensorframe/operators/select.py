"""Projection, range selection, coverage and emptiness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.cftime import bound_column, parse_bound, time_text
from sensorframe.functions.values import nans_to_null
from sensorframe.operators.joins import join_on_keys, sized_join

MODES = ("reference", "inclusive")


def project(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only the named columns (and ``keep``); names the table lacks are ignored."""
    if isinstance(names, str):
        raise TypeError("give a list of column names")
    wanted = {*names, *keep}
    return df.select([c for c in df.columns if c in wanted])


def axis_columns(x: str, y: str, color: str = "") -> list[str]:
    """The distinct non-empty axis variables, and always ``time``."""
    return list(dict.fromkeys([c for c in (x, y, color) if c] + ["time"]))


def axis_columns_of(x: Column, y: Column, color: Column) -> Column:
    """``axis_columns`` for a table of requests."""
    return F.array_distinct(F.filter(F.array(x, y, color, F.lit("time")), lambda c: c != ""))


def check_dimensions(names: Sequence[str], dims: Sequence[str]) -> None:
    for name in names:
        if name not in dims:
            raise ValueError(f"'{name}' is not a dimension in this data stream.")


def select_ranges(
    df: DataFrame,
    ranges: Mapping[str, tuple | None],
    mode: str = "reference",
    by: Sequence[str] = (),
    positions: Mapping[str, str] | None = None,
    ordered: Sequence[str] = (),
) -> DataFrame:
    """Rows inside the given ``dimension -> (low, high)`` ranges; ``None`` means all.

    ``inclusive`` is a plain filter. ``reference`` cuts by position: from the
    first matching row up to, not including, the last one; rows between them
    stay even if they do not match. ``positions`` names the column holding the
    row position along a dimension (``_pos`` for ``time``); a dimension without
    one is filtered. A dimension listed in ``ordered`` grows with its position,
    so the range filter itself is kept and reaches the scan.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    positions = {"time": "_pos"} if positions is None else dict(positions)
    wanted = {d: range_bounds(r) for d, r in ranges.items() if r is not None}
    inside = {d: F.col(d).between(low, high) for d, (low, high) in wanted.items()}
    cut = [d for d in wanted if mode == "reference" and d in positions]

    out = df
    for d in wanted:
        if d not in cut or d in ordered:
            out = out.where(inside[d])
    if not cut:
        return out
    edges = []
    for d in cut:
        position = F.when(inside[d], F.col(positions[d]))
        edges += [F.min(position).alias(f"_from_{d}"), F.max(position).alias(f"_to_{d}")]
    # With one dimension the bounds scan can be pruned too.
    probe = df.where(inside[cut[0]]) if len(cut) == 1 else df
    if by:
        # One row per group, measured before it is broadcast: the rows are never shuffled for it.
        out = sized_join(out, probe.groupBy(*by).agg(*edges), by, "inner", costly=True)
        limit = {name: F.col(name) for d in cut for name in (f"_from_{d}", f"_to_{d}")}
    else:
        found = probe.agg(F.struct(*edges).alias("edges")).scalar()
        limit = {name: found[name] for d in cut for name in (f"_from_{d}", f"_to_{d}")}
    for d in cut:
        position = F.col(positions[d])
        out = out.where((position >= limit[f"_from_{d}"]) & (position < limit[f"_to_{d}"]))
    return out.select(*df.columns)


def select_time(
    df: DataFrame,
    start: str | datetime,
    end: str | datetime,
    mode: str = "reference",
    by: Sequence[str] = (),
    time: str = "time",
    position: str = "_pos",
    ordered: bool = False,
) -> DataFrame:
    return select_ranges(df, {time: (start, end)}, mode, by, {time: position}, [time] if ordered else [])


def range_bounds(pair: tuple) -> tuple[Column, Column]:
    """Both ends of a range as columns."""
    low, high = (pair.start, pair.stop) if isinstance(pair, slice) else pair
    return _bound(low), _bound(high)


def _bound(value) -> Column:
    if isinstance(value, Column):
        return value
    return bound_column(value) if isinstance(value, (str, datetime)) else F.lit(value)


def stream_extents(samples: DataFrame, by: Sequence[str] = ("stream",), time: str = "time") -> DataFrame:
    """First and last time of every stream."""
    return samples.groupBy(*by).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def covers(start: Column, end: Column, first: Column, last: Column, mode: str = "reference") -> Column:
    """Does a stream cover a request?

    ``reference``: one of the two ends lies in ``[first, last)``, so a request
    that encloses the stream is not covered. ``overlap``: the spans intersect
    (a reversed request has no span).
    """
    if mode == "overlap":
        found = (start <= end) & (start <= last) & (end >= first)
    elif mode == "reference":
        found = ((start >= first) & (start < last)) | ((end >= first) & (end < last))
    else:
        raise ValueError("mode is 'reference' or 'overlap'")
    return F.coalesce(found, F.lit(False))


def spans_meet(start, end, first: datetime | None, last: datetime | None, mode: str = "reference") -> bool:
    """``covers`` for one request and one stream with a known extent."""
    start, end = parse_bound(start), parse_bound(end)
    if mode not in ("reference", "overlap"):
        raise ValueError("mode is 'reference' or 'overlap'")
    if None in (start, end, first, last):
        return False
    if mode == "overlap":
        return start <= end and start <= last and end >= first
    return first <= start < last or first <= end < last


def coverage(
    requests: DataFrame, extents: DataFrame, mode: str = "reference", start: str = "start", end: str = "end"
) -> DataFrame:
    """Requests (one row per stream) with ``first_time``, ``last_time`` and ``covered``."""
    joined = join_on_keys(requests, extents, ["stream"])
    return joined.withColumn(
        "covered", covers(F.col(start), F.col(end), F.col("first_time"), F.col("last_time"), mode)
    )


def empty_streams(requests: DataFrame, matches: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request the requested streams without any row in ``matches`` (key, stream)."""
    missing = requests.join(matches.select(key, "stream").distinct(), [key, "stream"], "left_anti")
    # A request names its streams in one text value, so its list is bounded by that.
    return missing.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("stream")), ",").alias("empty_streams"))


def plot_points(df: DataFrame, x: str, y: str, color: str = "") -> DataFrame:
    """The non-empty axis columns with NaN as null and time as text."""
    names = list(dict.fromkeys(c for c in (x, y, color) if c))
    clean = nans_to_null(df.select(*names))
    if "time" in names:
        clean = clean.withColumn("time", time_text(F.col("time")))
    return clean


def swap_key(df: DataFrame, x: str) -> DataFrame:
    """Put ``x`` first as the key; ``time`` becomes an ordinary column."""
    return df.select(x, *[c for c in df.columns if c != x])
