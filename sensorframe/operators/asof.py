"""As-of join: the sample at or around the time of each row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.cftime import from_micros, to_micros
from sensorframe.operators.neighbours import with_neighbours
from sensorframe.operators.ranges import bucket_of, range_ordered

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    direction: str = "backward",
    tolerance: timedelta | None = None,
    matched_time: str = "matched_time",
    partitions: int | None = None,
) -> DataFrame:
    """Each left row with ``values`` of the right row before, after or nearest in time.

    At equal distance the earlier sample wins. Both sides are put in one range
    order over (``by``, time); a hot key or instant is cut at any row, because
    the neighbour is carried across the cuts.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    rows = left.select(
        *by,
        to_micros(F.col(left_time)).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_row"),
    )
    sample = F.struct(to_micros(F.col(right_time)).alias("t"), *values)
    samples = right.dropna("any", subset=[*by, right_time]).select(
        *by, to_micros(F.col(right_time)).alias("_t"), F.lit(0).alias("_side"), sample.alias("_sample")
    )
    both = samples.unionByName(rows, allowMissingColumns=True)
    # Samples sort before rows of the same instant, so "backward" includes equal times.
    placed = range_ordered(both, [*by, "_t", "_side"], "_place", partitions)
    placed = placed.withColumn("_bucket", bucket_of("_place"))
    near = with_neighbours(
        placed,
        by,
        "_bucket",
        "_place",
        previous={"_before": F.col("_sample")},
        following={"_after": F.col("_sample")} if direction != "backward" else {},
    ).where(F.col("_side") == 1)

    before, now = F.col("_before"), F.col("_t")
    if direction == "backward":
        pick = before
    else:
        after = F.col("_after")
        if direction == "forward":
            use_before = before["t"] == now
        else:
            use_before = after.isNull() | (now - before["t"] <= after["t"] - now)
        pick = F.when(before.isNotNull() & use_before, before).otherwise(after)
    if tolerance is not None:
        limit = tolerance // timedelta(microseconds=1)
        pick = F.when(F.abs(now - pick["t"]) <= limit, pick)
    # A row without a time has no neighbour; one without a key meets no sample.
    near = near.withColumn("_pick", F.when(now.isNotNull(), pick))
    return near.select(
        *[F.col("_row")[c].alias(c) for c in left.columns],
        from_micros(F.col("_pick")["t"]).alias(matched_time),
        *[F.col("_pick")[v].alias(v) for v in values],
    )
