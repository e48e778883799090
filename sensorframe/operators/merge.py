"""Merging frames on a key (full outer, with conflict check) and unions by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.values import nans_to_null


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column a frame lacks is null there."""
    if not frames:
        raise ValueError("a union needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    return union_by_name([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def merged_value(name: str, on_conflict: str = "error") -> Column:
    """Aggregate: the one non-null value of a column within a key, or an error."""
    return _agreed(name, F.min(name), F.max(name), on_conflict)


def merged_of(columns: Sequence[Column], name: str, on_conflict: str = "error") -> Column:
    """The one non-null value of several columns of a row, or an error."""
    if len(columns) == 1:
        return columns[0]
    return _agreed(name, F.least(*columns), F.greatest(*columns), on_conflict)


def _agreed(name: str, low: Column, high: Column, on_conflict: str) -> Column:
    if on_conflict == "keep":
        return high
    if on_conflict != "error":
        raise ValueError("on_conflict is 'error' or 'keep'")
    message = F.concat(
        F.lit(f"conflicting values for '{name}': "), low.cast("string"), F.lit(" and "), high.cast("string")
    )
    return F.when(low == high, high).when(low.isNotNull(), F.raise_error(message))


def merge_on(frames: Sequence[DataFrame], key: str = "time", on_conflict: str = "error") -> DataFrame:
    """Full outer merge of any number of frames on ``key`` in a single shuffle.

    Equal to a chain of full outer joins that coalesce same-named columns, for
    frames with one row per key. NaN is no value, as null is none. Two different values are an error;
    ``merge_conflicts`` lists them instead.
    """
    rows = nans_to_null(union_by_name(frames))
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*[merged_value(n, on_conflict).alias(n) for n in names])


def merge_conflicts(frames: Sequence[DataFrame], key: str = "time") -> DataFrame:
    """The (key, variable) pairs with more than one value, with the extremes as text; NaN is no value."""
    rows = nans_to_null(union_by_name(frames))
    names = [c for c in rows.columns if c != key]
    extremes = rows.groupBy(key).agg(
        *[F.min(n).alias(f"low_{n}") for n in names], *[F.max(n).alias(f"high_{n}") for n in names]
    )
    found = [
        F.when(
            F.col(f"low_{n}") != F.col(f"high_{n}"),
            F.struct(
                F.lit(n).alias("variable"),
                F.col(f"low_{n}").cast("string").alias("low"),
                F.col(f"high_{n}").cast("string").alias("high"),
            ),
        )
        for n in names
    ]
    conflicts = F.explode(F.array_compact(F.array(*found)))
    return extremes.select(key, conflicts.alias("c")).select(key, "c.*")


def suffix_variables(frames: Mapping[str, DataFrame], key: str = "time") -> list[DataFrame]:
    """Rename every variable to ``<variable>_<stream>`` so that overlays cannot collide."""
    return [
        df.select(key, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != key]) for name, df in frames.items()
    ]
