"""Cruise-sample files, source list, label map and sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.values import SENTINEL_TEXT
from sensorframe.operators.joins import sized_join
from sensorframe.operators.labels import LABEL_COLUMNS, parse_headers
from sensorframe.operators.neighbours import running_totals
from sensorframe.session import materialize

SAMPLE_TABLES = ("profile", "discrete")
LABEL_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in LABEL_COLUMNS])


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def plain_path(path: Column) -> Column:
    """A path without the ``file:`` scheme, as the two spellings of a local file must match."""
    return F.regexp_replace(path, r"^file:/+", "/")


def read_path() -> Column:
    """Path of the file a row was read from, as it was asked for (Spark reports it URL-encoded)."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.url_decode(encoded))


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, place, record``: the records of CSV files, in which quoted cells may hold line breaks.

    Files are read in splits, by lines. A line begins a record if the quotes before it in
    its file are even in number: that is a running total inside a split plus the
    totals of the splits before. Only lines of records that span several
    are brought together. ``place`` (split, line) grows along the file; blank lines between
    records are none. A quote that is never closed makes the rest of its file one record.
    """
    lines = spark.read.text(list(paths)).select(
        read_path().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
    lines = lines.withColumn("quotes", quotes)
    counted = running_totals(lines, ["file"], "block", "line", {"before": F.col("quotes")})
    begins, closed = F.col("before") % 2 == 0, F.col("quotes") % 2 == 0
    place = F.struct("block", "line")
    single = counted.where(begins & closed & (F.trim("value") != "")).select("file", place.alias("place"), F.col("value").alias("record"))
    open_lines = counted.where(~(begins & closed)).withColumn("begins", begins.cast("bigint"))
    numbered = running_totals(open_lines, ["file"], "block", "line", {"earlier": F.col("begins")})
    parts = numbered.groupBy("file", (F.col("earlier") + F.col("begins")).alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts")
    )
    first = F.get("parts", F.lit(0))
    several = parts.select(
        "file", F.struct(first["block"].alias("block"), first["line"].alias("line")).alias("place"), F.array_join("parts.value", "\n").alias("record")
    )
    return single.unionByName(several)


def header_records(records: DataFrame) -> DataFrame:
    """``file, first, record``: the first record of every file and its place."""
    first = records.groupBy("file").agg(F.min("place").alias("first"), F.min_by("record", "place").alias("record"))
    return first.withColumn("record", F.regexp_replace("record", "^\ufeff", ""))


def header_cells(headers: DataFrame) -> DataFrame:
    """``file, position, header`` for the cells of header records; line breaks are spaces."""
    cells = F.split("record", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    unquoted = F.transform(
        cells,
        lambda c: F.regexp_replace(
            F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')), r"\s*[\r\n]+\s*", " "
        ),
    )
    return headers.select("file", F.posexplode(unquoted).alias("position", "header"))


def read_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, position, header`` for the header cells of every file."""
    return header_cells(header_records(read_records(spark, paths)))


def _parsed(record: Column, width: int) -> Column:
    """The cells of a record as an array; empty ones and the missing-data marker are null."""
    schema = ", ".join(f"_c{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "nullValue": SENTINEL_TEXT[0]}
    row = F.from_csv(record, F.lit(schema), options)
    return F.get(F.transform(F.array(row), lambda r: F.array(*[r[f"_c{i}"] for i in range(width)])), F.lit(0))


def read_text_csv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """CSV files with one header, every column text, empty cells and the missing-data marker as null.

    Quotes are doubled inside quotes, and quoted cells may hold commas and line breaks.
    """
    records = materialize(read_records(spark, [paths] if isinstance(paths, str) else list(paths)))
    first = header_records(records).select("file", "first")
    rows = sized_join(records, first, ["file"], "inner", F.col("place") > F.col("first"), costly=True)
    cells = rows.select(_parsed(F.col("record"), len(names)).alias("_cells"))
    return cells.select(*[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_cruises(
    spark: SparkSession, sources: DataFrame, file_column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """All files of a source list (``cruise_id, array_rd, summary_url``) as (samples, labels).

    One scan of all files, whatever headers they have: every cell finds its column through
    the header table of its file, which is joined on the executors. Cells are text, empty ones
    and the missing-data marker null; cells beyond the header are left out. Rows get ``cruise_id`` and ``array_rd`` from their source, and the path of
    their file in ``file_column`` if that is named. Labels carry ``array_rd`` and
    ``source_order`` (the place in the list). A file without a header has no rows.
    """
    listed = number_sources(sources).select(
        plain_path(F.col("summary_url")).alias("file"), "cruise_id", "array_rd", "source_order", "summary_url"
    )
    # The list of files to open; Spark's own file listing keeps the same list on the driver.
    urls = [r["summary_url"] for r in listed.select("summary_url").distinct().collect()]
    wrong = sorted(u for u in urls if not u.lower().endswith(".csv"))
    if wrong:
        raise ValueError(f"only .csv sources can be read: {', '.join(wrong)}")
    if urls:
        records = materialize(read_records(spark, urls))
    else:
        records = spark.createDataFrame([], "file string, place struct<block:bigint,line:bigint>, record string")
    # Stored once, as labels, columns and label maps all read these small tables.
    firsts = materialize(header_records(records))
    headers = materialize(parse_headers(header_cells(firsts)))
    per_file = headers.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("cells"))
    per_file = per_file.select("file", F.col("cells.name").alias("names"))
    twice = per_file.where(F.size(F.array_distinct("names")) < F.size("names")).first()
    if twice is not None:
        again = sorted({n for n in twice["names"] if twice["names"].count(n) > 1})
        raise ValueError(f"headers of {twice['file']} give the same column twice: {', '.join(again)}")
    # The columns of the result: one entry for each name, however many files and headers there are.
    columns = [r["name"] for r in headers.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy("name").collect()]
    width = (headers.agg(F.max("position").alias("p")).first()["p"] or 0) + 1
    all_names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    places = per_file.select("file", F.transform(all_names, lambda n: F.array_position("names", n).cast("int")).alias("at"))
    about = places.join(firsts.select("file", "first"), "file").join(listed.select("file", "cruise_id", "array_rd"), "file")
    rows = sized_join(records, about, ["file"], "inner", F.col("place") > F.col("first"), costly=True)
    parsed = rows.withColumn("_cells", _parsed(F.col("record"), width))
    cells = [F.get("_cells", F.get("at", F.lit(i)) - 1).alias(c) for i, c in enumerate(columns)]
    kept = [F.col("file").alias(file_column)] if file_column else []
    samples = parsed.select(*cells, *kept, "cruise_id", "array_rd")
    labels = headers.join(listed.select("file", "array_rd", "source_order"), "file")
    return samples, labels.select("array_rd", "source_order", *LABEL_COLUMNS)


def number_sources(sources: DataFrame) -> DataFrame:
    """``source_order`` from the list's own order, unless it already has one."""
    if "source_order" in sources.columns:
        return sources
    return sources.withColumn("source_order", F.monotonically_increasing_id())


def write_sources(sources: DataFrame, path: str) -> None:
    sources.write.mode("overwrite").json(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    names = ("cruise_id", "array_rd", "summary_url")
    schema = _text_schema(names).add("source_order", T.LongType())
    return spark.read.schema(schema).json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select(*LABEL_COLUMNS).write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)


def write_samples(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """A sample table as Parquet, in ``partitions`` files of equal row counts.

    Without a number the table keeps its partitioning, as a fixed small number
    of files would push a large table through as few tasks.
    """
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, root: str, table: str) -> DataFrame:
    if table not in SAMPLE_TABLES:
        raise ValueError(f"{table} is invalid. Valid values: {', '.join(SAMPLE_TABLES)}")
    return spark.read.parquet(f"{root}/{table}")


def to_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON record; null fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
