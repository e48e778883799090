"""Previous / following non-null value of every row, without a sort over a whole group.

A plain window over a group sends the group to one task. Here every group is
cut into buckets of bounded size; windows run inside a bucket, and what has to
cross a bucket edge travels through a summary of one row per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators.joins import join_on_keys


def with_neighbours(
    df: DataFrame,
    by: Sequence[str],
    bucket: str | None,
    order: str,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per output name, the nearest non-null value before / after each row.

    ``bucket`` must not decrease with ``order`` inside a group, and ``order``
    must be unique inside a group. The row's own value is never used. Without a
    ``bucket`` every group is one; that is for groups of a known small size.
    Both directions are running frames; a frame that reaches forward would be
    recomputed for every row.
    """
    previous, following = dict(previous or {}), dict(following or {})
    keys = [*by, bucket] if bucket else [*by]
    values = {**previous, **following}
    staged = df.withColumns({f"_v_{n}": c for n, c in values.items()})

    inside = W.partitionBy(*keys)
    local = staged.withColumns(
        {
            **{f"_l_{n}": _running(f"_v_{n}", inside.orderBy(order)) for n in previous},
            **{f"_l_{n}": _running(f"_v_{n}", inside.orderBy(F.desc(order))) for n in following},
        }
    )
    if bucket is None:
        return local.select(*df.columns, *[F.col(f"_l_{n}").alias(n) for n in values])

    last_one = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) for n in previous}
    first_one = {n: F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) for n in following}
    summary = staged.groupBy(*keys).agg(*[c.alias(f"_e_{n}") for n, c in {**last_one, **first_one}.items()])
    # Over the summary only: one row per bucket, never the rows themselves.
    across = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    carried = summary.select(
        *keys,
        *[_running(f"_e_{n}", across.orderBy(bucket)).alias(f"_c_{n}") for n in previous],
        *[_running(f"_e_{n}", across.orderBy(F.desc(bucket))).alias(f"_c_{n}") for n in following],
    )

    joined = join_on_keys(local, carried, keys)
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values],
    )


def _running(name: str, window: W) -> Column:
    return F.last(name, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))


def running_totals(df: DataFrame, by: Sequence[str], bucket: str, order: str, values: Mapping[str, Column]) -> DataFrame:
    """Add, per output name, the sum of a value over all rows of the group before each row.

    ``bucket`` and ``order`` are those of ``with_neighbours``: windows run inside a
    bucket, and over one row per bucket.
    """
    keys = [*by, bucket]
    staged = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    local = staged.withColumns({f"_l_{n}": _sum_before(f"_v_{n}", W.partitionBy(*keys).orderBy(order)) for n in values})
    summary = staged.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    carried = summary.select(*keys, *[_sum_before(f"_e_{n}", W.partitionBy(*by).orderBy(bucket)).alias(f"_c_{n}") for n in values])
    joined = join_on_keys(local, carried, keys)
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in values])


def _sum_before(name: str, window: W) -> Column:
    return F.coalesce(F.sum(name).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
