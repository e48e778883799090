"""Label tables (name, display name, unit): precedence, latest source, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.samples import header_display, header_name, header_unit, header_words
from sensorframe.operators.joins import sized_join

LABEL_COLUMNS = ("name", "display_name", "unit")


def parse_headers(headers: DataFrame, column: str = "header") -> DataFrame:
    """Add ``name``, ``display_name`` and ``unit``; a header without words is an error."""
    raw = F.col(column)
    checked = F.when(
        header_words(raw) == "", F.raise_error(F.concat(F.lit("header without a name: "), raw)).cast("string")
    ).otherwise(raw)
    return headers.withColumns(
        {"name": header_name(checked), "display_name": header_display(checked), "unit": header_unit(raw)}
    )


def latest_labels(labels: DataFrame, by: str = "array_rd", order: str = "source_order") -> DataFrame:
    """The labels of the last source of every array; an aggregate, so no array is sorted."""
    last = labels.groupBy(by).agg(F.max(order).alias(order))
    joined = sized_join(labels, last.withColumnRenamed(order, "_last"), [by], costly=True)
    return joined.where(F.col(order) == F.col("_last")).drop("_last")


def merge_labels(first: DataFrame, second: DataFrame, key: str = "name") -> DataFrame:
    """All of ``first``, and of ``second`` what ``first`` does not name."""
    missing = second.join(first.select(key).distinct(), key, "left_anti").select(*second.columns)
    return first.unionByName(missing)


def lookup_labels(names: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """Requested names with their labels; an unknown one gets a ``msg``."""
    found = labels.select(key, *[c for c in LABEL_COLUMNS if c != key], F.lit(True).alias("_found"))
    joined = sized_join(names, found, [key], "left")
    message = F.when(F.col("_found").isNull(), F.concat(F.col(key), F.lit(" not found.")))
    return joined.withColumn("msg", message).drop("_found")


def keyed_labels(labels: DataFrame, key: str = "name") -> DataFrame:
    """The label map as one ``map<name, (display_name, unit)>``; it holds one entry per column name."""
    entry = F.struct(F.col(key), F.struct(*[c for c in LABEL_COLUMNS if c != key]))
    return labels.agg(F.map_from_entries(F.collect_list(entry)).alias("labels"))


