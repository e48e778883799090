"""How many rows lie in each of many ranges, without joining rows with ranges.

The bounds of all ranges cut the order of a group into intervals. Rows are first added
up by cell: a coarse cell where it holds no bound, else a fine one, else a single
value. Every cell then lies in one interval, that of the last bound before it. What is
left is one row per bound, and the count of a range is the difference of two running
totals; least and greatest values come from a dyadic tree over the intervals. The cost
is that of the rows plus that of the ranges, however many ranges a row lies in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.joins import fits_broadcast, join_on_keys, sized_join
from sensorframe.operators.neighbours import running_totals, with_neighbours
from sensorframe.session import materialize

# Bits below a coarse and a fine cell: for microseconds about 38 hours and one second. A fine
# cell has no more than 2**FINE values, a coarse one no more than 2**(COARSE - FINE) fine ones.
COARSE, FINE = 37, 20


def _cell(at: Column, bits: int) -> Column:
    return F.shiftright(at, bits)


def _cells(rows: DataFrame, points: DataFrame, by: Sequence[str], fits: bool) -> DataFrame:
    """Rows added up by cell: ``(by..., _at, _n, _least, _greatest)``; no cell but a single value holds a point."""
    marks = {}
    for name, bits in (("coarse", COARSE), ("fine", FINE)):
        touched = points.select(*by, _cell(F.col("_at"), bits).alias(f"_{name}")).distinct()
        marks[name] = touched.withColumn(f"_in_{name}", F.lit(True))
    keyed = rows.withColumns({"_coarse": _cell(F.col("_at"), COARSE), "_fine": _cell(F.col("_at"), FINE)})
    # Cells are distinct: a row meets one of them or none.
    for name, touched in marks.items():
        keyed = sized_join(keyed, touched, [*by, f"_{name}"], "left", fits=fits)
    begin = (
        F.when(F.col("_in_coarse").isNull(), F.shiftleft("_coarse", COARSE))
        .when(F.col("_in_fine").isNull(), F.shiftleft("_fine", FINE))
        .otherwise(F.col("_at"))
    )
    return keyed.groupBy(*by, begin.alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_greatest")
    )


def _intervals(rows: DataFrame, points: DataFrame, by: Sequence[str], fits: bool) -> DataFrame:
    """Per point the rows from it up to the next one: ``_n``, ``_least``, ``_greatest``; rows before all points are left out."""
    cells = _cells(rows, points, by, fits)
    none = F.lit(None).cast("bigint")
    # At equal values the point comes first: its interval begins with them.
    ordered = cells.select(*by, "_at", "_n", "_least", "_greatest", none.alias("_point"), (F.col("_at") * 2 + 1).alias("_order"))
    marks = points.select(
        *by, "_at", F.lit(0).cast("bigint").alias("_n"), none.alias("_least"), none.alias("_greatest"), F.col("_at").alias("_point"), (F.col("_at") * 2).alias("_order")
    )
    both = ordered.unionByName(marks).withColumn("_bucket", _cell(F.col("_at"), COARSE))
    placed = with_neighbours(both, by, "_bucket", "_order", previous={"_before": F.col("_point")})
    owner = F.coalesce("_point", "_before")
    return placed.groupBy(*by, owner.alias("_at")).agg(
        F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_greatest").alias("_greatest")
    ).where(F.col("_at").isNotNull())


def range_counts(
    ranges: DataFrame,
    rows: DataFrame,
    by: Sequence[str],
    at: Column,
    low: str,
    high: str,
    value: Column | None = None,
) -> DataFrame:
    """``ranges`` with ``n``, the rows of the same group whose ``at`` is in ``[low, high)``.

    ``at``, ``low`` and ``high`` are whole numbers (bigint). With ``value`` (bigint) the
    ``least`` and ``greatest`` one in the range are added. A null or reversed range, and
    one of a group without rows, has ``n`` 0. Each range comes back once, repeated ones too;
    rows without ``at`` are in no range. Names that begin with ``_`` are taken.
    """
    numbered = materialize(ranges.withColumn("_id", F.monotonically_increasing_id()))
    fits = fits_broadcast(numbered)
    # A measured small table lies in one partition: its steps then need no exchange.
    small = (lambda df: df.coalesce(1)) if fits else (lambda df: df)
    numbered = small(numbered)
    valid = numbered.where(F.col(low) < F.col(high))
    ends = [valid.select(*by, F.col(c).alias("_at")) for c in (low, high)]
    points = small(ends[0].union(ends[1])).distinct()
    points = points if fits else materialize(points)
    rows = rows.select(*by, at.cast("bigint").alias("_at"), (F.lit(None).cast("bigint") if value is None else value).alias("_value"))
    # One row per point; everything from here on is of the size of the ranges.
    found = small(materialize(_intervals(rows.where(F.col("_at").isNotNull()), points, by, fits)))
    totals = running_totals(
        found.withColumn("_bucket", _cell(F.col("_at"), COARSE)),
        by,
        "_bucket",
        "_at",
        {"_rank": F.col("_n"), "_index": F.lit(1).cast("bigint")},
    ).drop("_bucket")
    out = valid.select("_id", *by, low, high)
    for name, c in (("low", low), ("high", high)):
        bounds = totals.select(*by, F.col("_at").alias(c), F.col("_rank").alias(f"_rank_{name}"), F.col("_index").alias(f"_index_{name}"))
        out = join_on_keys(out, bounds, [*by, c])
    counts = out.select("_id", *by, (F.col("_rank_high") - F.col("_rank_low")).alias("n"), "_index_low", "_index_high")
    if value is not None:
        counts = counts.join(_extremes(counts, totals, by, found.count()), "_id", "left")
    answer = numbered.join(counts.drop(*by, "_index_low", "_index_high"), "_id", "left").drop("_id")
    return answer.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def _extremes(counts: DataFrame, totals: DataFrame, by: Sequence[str], n_points: int) -> DataFrame:
    """Per range the least and greatest value of its intervals, from nodes of a dyadic tree over them."""
    levels = F.sequence(F.lit(0), F.lit(max(n_points, 1).bit_length()))
    spread = totals.where("_n > 0").select(*by, "_index", "_least", "_greatest", F.explode(levels).alias("_level"))
    node = lambda: F.expr("shiftright(_index, _level)")
    nodes = spread.groupBy(*by, "_level", node().alias("_node")).agg(F.min("_least").alias("_least"), F.max("_greatest").alias("_greatest"))
    # A range of intervals is made of an odd first and an odd last node of each level.
    level = counts.where("n > 0").select("_id", *by, "_index_low", "_index_high", F.explode(levels).alias("_level"))
    first, last = F.expr("-shiftright(-_index_low, _level)"), F.expr("shiftright(_index_high, _level)")
    level = level.withColumns({"_first": first, "_last": last}).where("_first < _last")
    ends = F.array(F.when(F.col("_first") % 2 == 1, F.col("_first")), F.when(F.col("_last") % 2 == 1, F.col("_last") - 1))
    wanted = level.select("_id", *by, "_level", F.explode(ends).alias("_node")).where(F.col("_node").isNotNull())
    joined = join_on_keys(wanted, nodes, [*by, "_level", "_node"], "inner")
    return joined.groupBy("_id").agg(F.min("_least").alias("least"), F.max("_greatest").alias("greatest"))
