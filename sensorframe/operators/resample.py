"""Regular time grid, linear interpolation, bounded nearest fill, and alignment.

The work is done on *cells*, the spans between two grid ticks. Of all samples
in a cell only the first and the last can be a neighbour of a tick, so a
partial aggregation shrinks the samples to at most one row per group and tick
before the first shuffle, however many samples a hot group holds. Between
neighbouring cells lie runs of ticks on one straight line per variable; nearest
fill is worked out on runs as well. Runs are cut at bucket edges and spread, and
only then expanded to ticks. Expanded rows are neither sorted nor shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.cftime import bound_micros, from_micros, to_micros
from sensorframe.functions.values import nan_to_null
from sensorframe.operators.joins import fits_broadcast, sized_join
from sensorframe.operators.merge import merged_of, merged_value
from sensorframe.operators.neighbours import with_neighbours
from sensorframe.session import materialize

ONE_SECOND = timedelta(seconds=1)
ONE_DAY = timedelta(days=1)
# Ticks expanded as one bucket, ticks whose cells one window may sort, ticks per task,
# and the widest row (streams times variables) of a merge without aggregation; a wider
# one is aggregated, with the same result.
MIN_BUCKET_TICKS = 4096
HOME_TICKS = 262_144
TICKS_PER_TASK = 1_000_000
WIDEST_MERGE = 64
DUPLICATES = ("error", "first", "unique", "all")


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


@dataclass(frozen=True)
class Grid:
    """Ticks ``start + i * step`` for ``start <= tick < end``, in microseconds."""

    start: int
    end: int
    step: int

    @classmethod
    def of(cls, start: str | datetime, end: str | datetime, step: timedelta = ONE_SECOND) -> Grid:
        micros = step // timedelta(microseconds=1)
        if micros <= 0:
            raise ValueError("the grid step must be positive")
        return cls(bound_micros(start), bound_micros(end), micros)

    @property
    def ticks(self) -> int:
        return max(0, -((self.start - self.end) // self.step))

    @property
    def bucket_ticks(self) -> int:
        """Ticks per bucket; a square-root split bounds buckets and their number alike."""
        return max(MIN_BUCKET_TICKS, math.isqrt(self.ticks))

    @property
    def buckets(self) -> int:
        return -(-self.ticks // self.bucket_ticks)

    @property
    def home_ticks(self) -> int:
        """Ticks whose cells share a window; the square root again bounds windows and edges."""
        return max(HOME_TICKS, math.isqrt(self.ticks))

    @property
    def home(self) -> str | None:
        """The window bucket column, or none when the whole grid fits one."""
        return "_home" if self.ticks > self.home_ticks else None

    def time_of(self, tick: Column) -> Column:
        return tick * F.lit(self.step) + F.lit(self.start)

    def cell_of(self, micros: Column) -> Column:
        """Tick at or before a time; everything before the grid is -1, after it the last tick."""
        offset = micros - F.lit(self.start)
        cell = int_div(offset - F.pmod(offset, F.lit(self.step)), F.lit(self.step))
        return F.greatest(F.lit(-1).cast("bigint"), F.least(F.lit(self.ticks - 1).cast("bigint"), cell))

    def tasks(self, spark: SparkSession, groups: int = 1) -> int:
        """Tasks to expand in, a fixed number: before the expansion the data looks too small for them."""
        wanted = max(spark.sparkContext.defaultParallelism, groups * self.ticks // TICKS_PER_TASK)
        return max(1, min(groups * self.buckets, wanted))


def grid_ticks(spark: SparkSession, start, end, step: timedelta = ONE_SECOND, time: str = "time") -> DataFrame:
    """The grid itself, one row per tick, right-exclusive."""
    grid = Grid.of(start, end, step)
    return spark.range(grid.ticks).select(from_micros(grid.time_of(F.col("id"))).alias(time))


def resample(
    samples: DataFrame,
    start: str | datetime,
    end: str | datetime,
    step: timedelta = ONE_SECOND,
    by: Sequence[str] = ("stream",),
    time: str = "time",
    variables: Sequence[str] | None = None,
    max_gap: timedelta | None = None,
    duplicates: str = "error",
    position: str | None = None,
    categorical: str = "drop",
) -> DataFrame:
    """Samples to a regular grid, per group of ``by``.

    Numeric variables are interpolated linearly between neighbouring samples
    and are null outside them or next to a null; NaN counts as null. With ``max_gap`` the nulls are
    then filled with the nearest non-null grid value when the gap is at most
    that long (earlier value on a tie, edges included).

    ``duplicates``: what to do with several samples of one instant in a group:
    ``error`` (found before anything is returned; see ``_checked``), ``first``
    (lowest ``position``), ``all`` (see ``_cells_of_all``), or ``unique`` when the
    caller knows there are none.
    ``categorical``: other columns are dropped, or ``previous`` keeps the value
    of the last sample.
    """
    grid = Grid.of(start, end, step)
    runs, numeric, labels = _runs(samples, grid, by, time, variables, max_gap, duplicates, position, categorical)
    # Groups times ticks are the rows to come; counting the groups reads their columns only.
    groups = samples.select(*by).distinct().count() if by else 1
    ticks = _expand(_pieces(runs, grid, by, groups), grid, by, numeric, labels, max_gap is not None)
    return ticks.select(*by, from_micros(grid.time_of(F.col("_tick"))).alias(time), *numeric, *labels)


def align(
    samples: DataFrame,
    start: str | datetime,
    end: str | datetime,
    step: timedelta = ONE_SECOND,
    by: str = "stream",
    time: str = "time",
    variables: Sequence[str] | None = None,
    max_gap: timedelta | None = ONE_DAY,
    duplicates: str = "error",
    position: str | None = None,
    categorical: str = "drop",
    on_conflict: str = "error",
    streams: Sequence[str] = (),
    suffix: bool = False,
) -> DataFrame:
    """Resample every stream in one pass and merge the streams on time.

    All streams of one bucket meet in the same task, so the merge needs no
    shuffle of grid rows. When the ``streams`` are named, their runs are merged
    before they are expanded and every tick is made once; otherwise the ticks
    of all streams are aggregated. With ``suffix`` every variable becomes
    ``<variable>_<stream>`` and nothing can conflict.
    """
    if suffix and not streams:
        raise ValueError("suffix needs the names of the streams")
    grid = Grid.of(start, end, step)
    if streams:
        # Whatever way is taken below, streams that are not named take no part.
        samples = samples.where(F.col(by).isin(list(streams)))
    runs, numeric, labels = _runs(samples, grid, [by], time, variables, max_gap, duplicates, position, categorical)
    filled, names = max_gap is not None, [*numeric, *labels]
    tick_time = from_micros(grid.time_of(F.col("_tick"))).alias(time)
    if streams and len(streams) * len(names) <= WIDEST_MERGE:
        ticks = _expand_merged(_pieces(runs, grid), grid, by, streams, numeric, labels, filled)
        if suffix:
            return ticks.select(tick_time, *[F.col(f"{n}_{s}") for s in streams for n in names])
        values = [merged_of([F.col(f"{n}_{s}") for s in streams], n, on_conflict).alias(n) for n in names]
        return ticks.select(tick_time, *values)
    ticks = _expand(_pieces(runs, grid), grid, [by], numeric, labels, filled)
    aggregates = [merged_value(n, on_conflict).alias(n) for n in names]
    if suffix:
        own = {f"{n}_{s}": F.max(F.when(F.col(by) == s, F.col(n))) for s in streams for n in names}
        aggregates, names = [c.alias(n) for n, c in own.items()], list(own)
    return ticks.groupBy("_bucket", "_tick").agg(*aggregates).select(tick_time, *names)


def _runs(samples, grid, by, time, variables, max_gap, duplicates, position, categorical):
    """(runs, numeric variables, other variables); the runs of a group tile the grid."""
    wanted = [c for c in samples.columns if c not in (*by, time, position)]
    if variables is not None:
        wanted = [c for c in wanted if c in set(variables)]
    kinds = {f.name: f.dataType for f in samples.schema}
    numeric = [c for c in wanted if isinstance(kinds[c], T.NumericType)]
    if categorical not in ("drop", "previous"):
        raise ValueError("categorical is 'drop' or 'previous'")
    labels = [c for c in wanted if c not in numeric] if categorical == "previous" else []

    # A sample without a time or a group is part of no series.
    present = [F.col(c).isNotNull() for c in (*by, time)]
    clean = samples.where(reduce(and_, present)).select(
        *by,
        to_micros(F.col(time)).alias("_t"),
        *[nan_to_null(F.col(c).cast("double")).alias(c) for c in numeric],
        *labels,
        *([position] if position else []),
    )
    clean = _one_per_instant(clean, by, [*numeric, *labels], duplicates, position)
    if duplicates == "all":
        cells = _cells_of_all(clean, grid, by, numeric, labels, position)
    else:
        cells = _cells(clean, grid, by, numeric, labels)
    if duplicates == "error":
        cells = _checked(clean, cells, grid, by)
    runs = _lines(_segments(cells, grid, by, numeric, labels), grid, numeric)
    if max_gap is not None:
        runs = _with_fills(runs, grid, by, numeric, max_gap // timedelta(microseconds=1))
    return runs, numeric, labels


def _one_per_instant(clean, by, values, duplicates, position) -> DataFrame:
    if duplicates not in DUPLICATES:
        raise ValueError(f"duplicates is one of {', '.join(DUPLICATES)}")
    if duplicates != "first":
        return clean
    if position is None:
        raise ValueError("duplicates='first' needs a position column")
    kept = [F.min_by(c, position).alias(c) for c in values]
    return clean.groupBy(*by, "_t").agg(*kept) if kept else clean.select(*by, "_t").distinct()


def _checked(clean, cells, grid, by) -> DataFrame:
    """The cells, stored, after a look for several samples of one instant.

    A cell of one sample has none, and one of two has some only if both times agree.
    The instants of fuller cells are counted; of those samples only the time is exchanged,
    added up before it is.
    """
    cells = materialize(cells)
    full = cells.where("_n > 2 or (_n = 2 and _ft = _lt)").select(*by, "_cell")
    if not full.isEmpty():
        times = clean.select(*by, "_t", grid.cell_of(F.col("_t")).alias("_cell"))
        if fits_broadcast(full):
            times = sized_join(times, full, [*by, "_cell"], fits=True)
        again = times.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").first()
        if again is not None:
            at = datetime(1970, 1, 1) + timedelta(microseconds=again["_t"])
            raise ValueError(f"several samples at one time: {at}")
    return cells.drop("_n")


def _cells(clean, grid, by, numeric, labels) -> DataFrame:
    """First and last sample of each non-empty cell, and their number. All buffers are fixed-width, so it hashes."""
    names = [*numeric, *labels]
    staged = clean.withColumn("_cell", grid.cell_of(F.col("_t")))
    # Last before first, as in _segments: the optimizer merges the two, and only
    # aggregates that list their functions in one order are computed once.
    return staged.groupBy(*by, "_cell").agg(
        F.max("_t").alias("_lt"),
        *[F.max_by(c, "_t").alias(f"_l_{c}") for c in names],
        F.min("_t").alias("_ft"),
        *[F.min_by(c, "_t").alias(f"_f_{c}") for c in names],
        F.count(F.lit(1)).alias("_n"),
    )


def _cells_of_all(clean, grid, by, numeric, labels, position) -> DataFrame:
    """``_cells`` of samples that may share an instant: they all stand, in order of ``position`` and value.

    The line before an instant ends in the first of its samples, the line after it begins in the
    last, and a tick at the instant (``_h_``) has the last.
    """
    names = [*numeric, *labels]
    staged = clean.withColumn("_cell", grid.cell_of(F.col("_t")))
    place = F.struct("_t", *([position] if position else []), *numeric)
    on_tick = F.when(F.col("_t") == grid.time_of(F.col("_cell")), place)
    values = F.struct(*[c for c in ("_t", *names)])
    edges = staged.groupBy(*by, "_cell").agg(
        F.max_by(values, place).alias("_l"), F.min_by(values, place).alias("_f"), F.max_by(values, on_tick).alias("_h")
    )
    return edges.select(
        *by,
        "_cell",
        F.col("_l._t").alias("_lt"),
        F.col("_f._t").alias("_ft"),
        *[F.col(f"_{side}")[c].alias(f"_{side}_{c}") for side in "lfh" for c in names],
    )


def _segments(cells, grid, by, numeric, labels) -> DataFrame:
    """Runs of ticks ``_lo.._hi`` with a sample before (a) and a sample after (b) them.

    A sample exactly on a tick is a run of its own, with both sides at that
    sample. So within a run a variable is non-null at every tick or at none.
    """
    names = [*numeric, *labels]
    bucket = int_div(F.greatest(F.col("_cell"), F.lit(0)), F.lit(grid.home_ticks))
    # Both sides carry their sample, so the two uses of the cells read the same
    # columns and share one aggregation (and one scan) of the samples.
    last_of = F.struct(
        F.col("_cell").alias("cell"), F.col("_lt").alias("t"), *[F.col(f"_l_{c}").alias(c) for c in names]
    )
    first_of = F.struct(
        F.col("_cell").alias("cell"), F.col("_ft").alias("t"), *[F.col(f"_f_{c}").alias(c) for c in names]
    )
    linked = with_neighbours(
        cells.withColumn("_home", bucket),
        by,
        grid.home,
        "_cell",
        previous={"_prev": last_of},
        following={"_next": first_of},
    )
    kinds = {f.name: f.dataType for f in cells.schema}
    zero, last = F.lit(0).cast("bigint"), F.lit(grid.ticks - 1).cast("bigint")
    cell, nxt = F.col("_cell"), F.col("_next")
    own = {c: F.col(f"_f_{c}") for c in names}
    held = {c: F.col(f"_h_{c}") if f"_h_{c}" in cells.columns else own[c] for c in names}
    end = {c: F.col(f"_l_{c}") for c in names}
    after = {c: nxt[c] for c in names}
    nothing = {c: F.lit(None).cast(kinds[f"_f_{c}"]) for c in names}
    no_time = F.lit(None).cast("bigint")

    def run(lo, hi, at, a, bt, b):
        sides = [a[c].alias(f"_a_{c}") for c in names] + [b[c].alias(f"_b_{c}") for c in names]
        return F.struct(lo.alias("_lo"), hi.alias("_hi"), at.alias("_at"), bt.alias("_bt"), *sides)

    # The first cell of a group also opens the ticks before it.
    own_hit = F.col("_ft") == grid.time_of(cell)
    leading = F.when(F.col("_prev").isNull(), F.when(own_hit, cell - 1).otherwise(cell)).otherwise(F.lit(-1))
    hit = nxt["t"] == grid.time_of(nxt["cell"])
    reach = F.when(nxt.isNull(), last).otherwise(F.when(hit, nxt["cell"] - 1).otherwise(nxt["cell"]))
    at_hit = F.when(own_hit, cell).otherwise(F.lit(-1).cast("bigint"))
    runs = F.array(
        run(zero, leading.cast("bigint"), no_time, nothing, F.col("_ft"), own),
        run(F.greatest(at_hit, zero), at_hit, F.col("_ft"), held, F.col("_ft"), held),
        run(cell + 1, reach, F.col("_lt"), end, nxt["t"], after),
    )
    return (
        linked.select(*by, "_home", F.explode(runs).alias("_s"))
        .select(*by, "_home", "_s.*")
        .where(F.col("_lo") <= F.col("_hi"))
    )


def _lines(runs, grid, numeric) -> DataFrame:
    """Per variable the straight line ``base + slope * (time - _at)`` of a run, null where it has none."""
    span = F.col("_bt") - F.col("_at")
    lines = {}
    for c in numeric:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        lines[f"_base_{c}"] = F.when(b.isNotNull(), a)
        lines[f"_slope_{c}"] = F.when(span > 0, (b - a) / span).otherwise(F.lit(0.0))
    sides = [f"_{side}_{c}" for c in numeric for side in "ab"]
    return runs.withColumns(lines).drop("_bt", *sides)


def _line(c: str, grid: Grid, tick: Column, side=F.col) -> Column:
    return side(f"_base_{c}") + side(f"_slope_{c}") * (grid.time_of(tick) - side("_at"))


def _with_fills(runs, grid, by, numeric, gap: int) -> DataFrame:
    """Give every null run its nearest valid tick on both sides, as far as the gap allows.

    Up to the tick ``_cut`` a run then takes its line (the earlier value), after
    it ``_late`` (the later value); nothing has to look beyond its own run.
    """
    if not numeric:
        return runs
    lo, hi = F.col("_lo"), F.col("_hi")
    valid = {c: F.col(f"_base_{c}").isNotNull() for c in numeric}
    near = with_neighbours(
        runs,
        by,
        grid.home,
        "_lo",
        previous={
            f"_p_{c}": F.when(valid[c], F.struct(hi.alias("tick"), _line(c, grid, hi).alias("v"))) for c in numeric
        },
        following={
            f"_q_{c}": F.when(valid[c], F.struct(lo.alias("tick"), _line(c, grid, lo).alias("v"))) for c in numeric
        },
    )
    none, first_tick, last_tick = F.lit(None).cast("double"), F.lit(0), F.lit(grid.ticks - 1)
    changed = {}
    for c in numeric:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        length = (F.coalesce(q["tick"], last_tick) - F.coalesce(p["tick"], first_tick)) * F.lit(grid.step)
        fill = ~valid[c] & (length <= F.lit(gap))
        middle = F.when(p.isNull(), F.lit(-1)).when(q.isNotNull(), int_div(p["tick"] + q["tick"], F.lit(2)))
        changed[f"_base_{c}"] = F.when(valid[c], F.col(f"_base_{c}")).otherwise(F.when(fill, p["v"]).otherwise(none))
        changed[f"_slope_{c}"] = F.when(valid[c], F.col(f"_slope_{c}")).otherwise(F.lit(0.0))
        changed[f"_cut_{c}"] = F.coalesce(F.when(fill, middle), hi)
        changed[f"_late_{c}"] = F.when(fill, q["v"])
    filled = near.withColumns(changed).drop(*[f"_{side}_{c}" for c in numeric for side in "pq"])
    # A run outside the samples has no time of its own; its line is constant.
    return filled.withColumn("_at", F.coalesce("_at", F.lit(grid.start)))


def _pieces(runs, grid, by=(), groups: int = 1) -> DataFrame:
    """Runs cut at bucket edges, and all pieces of a bucket (of a group) brought to one task."""
    size = F.lit(grid.bucket_ticks).cast("bigint")
    bucket = F.col("_bucket")
    cut = runs.withColumn("_bucket", F.explode(F.sequence(int_div(F.col("_lo"), size), int_div(F.col("_hi"), size))))
    edges = {
        "_lo": F.greatest(F.col("_lo"), bucket * size),
        "_hi": F.least(F.col("_hi"), bucket * size + size - 1),
    }
    return cut.withColumns(edges).repartition(grid.tasks(runs.sparkSession, max(groups, 1)), *by, "_bucket")


def _value(c: str, grid: Grid, tick: Column, filled: bool, side=F.col) -> Column:
    line = _line(c, grid, tick, side)
    return F.when(tick <= side(f"_cut_{c}"), line).otherwise(side(f"_late_{c}")) if filled else line


def _expand(pieces, grid, by, numeric, labels, filled: bool) -> DataFrame:
    """One row per group and tick: ``by, _bucket, _tick`` and the variables."""
    ticks = pieces.withColumn("_tick", F.explode(F.sequence("_lo", "_hi")))
    values = [_value(c, grid, F.col("_tick"), filled).alias(c) for c in numeric]
    return ticks.select(*by, "_bucket", "_tick", *values, *[F.col(f"_a_{c}").alias(c) for c in labels])


def _expand_merged(pieces, grid, by, streams, numeric, labels, filled: bool) -> DataFrame:
    """One row per tick: ``_tick`` and ``<variable>_<stream>``.

    Where a piece starts, the latest pieces of the other streams still hold, as
    the pieces of every stream tile the bucket. A bucket has at most one piece
    per stream and tick.
    """
    parts = [f"_{p}_{c}" for c in numeric for p in (("base", "slope", "cut", "late") if filled else ("base", "slope"))]
    held = F.struct("_at", *parts, *[f"_a_{c}" for c in labels])
    order = W.partitionBy("_bucket").orderBy("_lo")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.lit(grid.bucket_ticks).cast("bigint")
    bucket_end = F.least((F.col("_bucket") + 1) * size, F.lit(grid.ticks).cast("bigint")) - 1
    joint = pieces.select(
        "_lo",
        F.coalesce(F.lead("_lo").over(order) - 1, bucket_end).alias("_hi"),
        *[
            F.last(F.when(F.col(by) == s, held), ignorenulls=True).over(so_far).alias(f"_s{i}")
            for i, s in enumerate(streams)
        ],
    )
    # Of several pieces that start together, only the last one knows all of them.
    ticks = joint.where(F.col("_lo") <= F.col("_hi")).withColumn("_tick", F.explode(F.sequence("_lo", "_hi")))
    values = []
    for i, s in enumerate(streams):
        side = F.col(f"_s{i}").getField
        values += [_value(c, grid, F.col("_tick"), filled, side).alias(f"{c}_{s}") for c in numeric]
        values += [side(f"_a_{c}").alias(f"{c}_{s}") for c in labels]
    return ticks.select("_tick", *values)
