"""Cruise samples end to end: read, clean, classify, split, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.samples import repair_station
from sensorframe.operators.clean import (
    cast_measurements,
    drop_empty_columns,
    drop_empty_rows,
    null_sentinels,
    parse_times,
    require_column,
)
from sensorframe.operators.labels import LABEL_COLUMNS, latest_labels, merge_labels
from sensorframe.operators.split import OPTIONAL_COLUMNS, derive_columns, split_samples
from sensorframe.session import materialize
from sensorframe.sources.samples import read_cruises, write_labels, write_samples, write_sources

TAGS = ("cruise_id", "array_rd")
FILE_TAG = "source_path"
# The arrays whose labels are kept, in order of precedence.
LABEL_ARRAYS = ("RS", "CE")


@dataclass(frozen=True)
class CruiseTables:
    profile: DataFrame
    discrete: DataFrame
    labels: DataFrame


def clean_samples(raw: DataFrame, strict: bool = False, only_codes: bool = False) -> DataFrame:
    """Text rows with normalised names and the tags ``cruise_id, array_rd`` to typed rows.

    Narrow throughout. ``strict`` adds one aggregate per source file, which the column
    ``source_path`` names; without that column a cruise counts as one file.
    """
    tags = [*TAGS, FILE_TAG] if FILE_TAG in raw.columns else [*TAGS]
    rows = require_column(null_sentinels(drop_empty_rows(raw, tags), tags), "cruise")
    rows = parse_times(rows)
    rows = rows.withColumn("station", repair_station(F.col("station"), F.col("array_rd"), only_codes))
    return cast_measurements(rows, strict, [FILE_TAG] if FILE_TAG in tags else ["cruise_id"]).drop(FILE_TAG)


def label_map(labels: DataFrame) -> DataFrame:
    """One label table: each array's last source, first array first."""
    latest = latest_labels(labels)
    first, second = (latest.where(F.col("array_rd") == a).select(*LABEL_COLUMNS) for a in LABEL_ARRAYS)
    return merge_labels(first, second)


def load_cruises(
    spark: SparkSession, sources: DataFrame, strict: bool = False, on_unknown: str = "error"
) -> CruiseTables:
    raw, labels = read_cruises(spark, sources, FILE_TAG if strict else None)
    # Stored once: three readers follow, and each needs only some of the columns.
    samples = materialize(derive_columns(clean_samples(raw, strict), on_unknown))
    profile, discrete = split_samples(samples)
    return CruiseTables(profile, drop_empty_columns(discrete, OPTIONAL_COLUMNS), label_map(labels))


def store_cruises(tables: CruiseTables, sources: DataFrame, root: str, partitions: int | None = None) -> None:
    write_sources(sources, f"{root}/sources")
    write_labels(tables.labels, f"{root}/labels")
    write_samples(tables.profile, f"{root}/profile", partitions)
    write_samples(tables.discrete, f"{root}/discrete", partitions)
