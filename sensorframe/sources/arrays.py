"""Chunked array folders (one folder per variable, one file per chunk) to stream tables.

Layout of a group: ``<variable>/.zarray`` (shape, chunks, dtype, compressor,
fill_value, order), ``<variable>/.zattrs`` (dimension names, time units) and the
chunk files ``<variable>/<i>`` or ``<variable>/<i>.<j>``. The first dimension is
``time``; a second one becomes an array column.

Chunks are decoded by the executors that read them. Decoded rows travel as
blocks of ``BLOCK_ROWS`` rows per variable, so aligning the variables shuffles
arrays, not single values, and no group holds more than one block per variable.

A cut is decided on the coordinates alone: they give ranges of indexes, these give
ranges of chunk numbers, and only the files of such names are listed and opened.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.cftime import DEFAULT_CALENDAR, DEFAULT_UNITS, decode_time
from sensorframe.functions.values import nan_to_null

BLOCK_ROWS = 4096
COMPRESSORS = ("zlib", "gzip", "zstd", "lz4")


@dataclass(frozen=True)
class ArrayMeta:
    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    compressor: str | None
    fill: float | int | str | None
    order: str
    dims: tuple[str, ...]
    attrs: dict

    @property
    def kept_in(self) -> str:
        """The field of a piece that holds the values: whole numbers and text keep their type."""
        kind = np.dtype(self.dtype).kind
        return "ints" if kind in "iub" else "texts" if kind in "US" else "data"


def read_metadata(spark: SparkSession, root: str) -> list[ArrayMeta]:
    """Metadata of every variable of a group: two small JSON files each.

    Read through Hadoop's file system, as Spark's sources skip dot files.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(conf)

    def load(path):
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    metas = []
    for status in files.listStatus(folder):
        variable = status.getPath()
        array = load(jvm.org.apache.hadoop.fs.Path(variable, ".zarray")) if status.isDirectory() else None
        if array is not None:
            attrs = load(jvm.org.apache.hadoop.fs.Path(variable, ".zattrs")) or {}
            metas.append(_meta(variable.getName(), array, attrs))
    return sorted(metas, key=lambda m: m.name)


def _meta(name: str, array: dict, attrs: dict) -> ArrayMeta:
    compressor = (array.get("compressor") or {}).get("id")
    if compressor is not None and compressor not in COMPRESSORS:
        raise ValueError(f"variable '{name}': compressor '{compressor}' is not supported")
    if array.get("filters"):
        raise ValueError(f"variable '{name}': filters are not supported")
    if len(array["shape"]) > 2:
        raise ValueError(f"variable '{name}': more than two dimensions are not supported")
    fill = array.get("fill_value")
    attrs = dict(attrs)
    dims = tuple(attrs.pop("_ARRAY_DIMENSIONS", ()))
    return ArrayMeta(
        name,
        tuple(array["shape"]),
        tuple(array["chunks"]),
        array["dtype"],
        compressor,
        _fill(fill, np.dtype(array["dtype"]).kind),
        array.get("order", "C"),
        dims,
        attrs,
    )


def _fill(value, kind: str):
    if value is None:
        return None
    return int(value) if kind in "iub" else str(value) if kind in "US" else float(value)


def _decompress(content: bytes, meta: ArrayMeta) -> bytes:
    if meta.compressor == "zlib":
        return zlib.decompress(content)
    if meta.compressor == "gzip":
        return gzip.decompress(content)
    if meta.compressor is None:
        return content
    size = int(np.prod(meta.chunks)) * np.dtype(meta.dtype).itemsize
    if meta.compressor == "lz4":
        # The codec stores the decoded size in four bytes before the block.
        return pa.Codec("lz4_raw").decompress(content[4:], decompressed_size=size).to_pybytes()
    return pa.Codec("zstd").decompress(content, decompressed_size=size).to_pybytes()


#: First index of a dimension and the one after the last.
Span = tuple[int, int]


def _spans(meta: ArrayMeta, cut: Mapping[str, Span]) -> tuple[Span, Span]:
    """The rows and the columns of a variable that are kept."""
    whole = [(0, n) for n in (*meta.shape, 1)][:2]
    kept = [cut.get(dimension, span) for dimension, span in zip(meta.dims, whole)]
    rows, columns = [*kept, *whole[len(kept) :]]
    return rows, columns


def _chunks_of(meta: ArrayMeta, cut: Mapping[str, Span]) -> tuple[Span, Span]:
    """The chunk numbers that hold them, along rows and along columns."""
    sizes = (*meta.chunks, 1)
    rows, columns = ((a // n, -(-b // n)) if a < b else (0, 0) for (a, b), n in zip(_spans(meta, cut), sizes))
    return rows, columns


def number_glob(first: int, last: int) -> str:
    """A glob for the decimal numbers from ``first`` to ``last``; it grows with their digits only."""
    parts = []
    while first <= last:
        step = 1
        while first >= step * 10 and first % (step * 10) == 0 and first + step * 10 - 1 <= last:
            step *= 10
        digit = first // step % 10
        more = min(9 - digit, (last - first + 1) // step - 1)
        head = str(first // (step * 10)) if first >= step * 10 else ""
        parts.append(f"{head}[{digit}-{digit + more}]" + "[0-9]" * (len(str(step)) - 1))
        first += (more + 1) * step
    return "{" + ",".join(parts) + "}"


def _name_glob(meta: ArrayMeta, cut: Mapping[str, Span]) -> str:
    """A glob for the names of the chunk files that are needed; any name where that is all of them."""
    if not any(dimension in cut for dimension in meta.dims):
        return "*"
    return ".".join(number_glob(a, b - 1) for a, b in _chunks_of(meta, cut)[: len(meta.shape)])


def _chunk_blocks(meta: ArrayMeta, i: int, j: int, content: bytes | None, cut: Mapping[str, Span]) -> Iterator[dict]:
    """One chunk as pieces that do not cross a block edge; a missing chunk is all fill value."""
    kind = {"ints": "int64", "texts": "object", "data": "float64"}[meta.kept_in]
    if content is None:
        # Without a fill value there is nothing to read: NaN, which becomes null, or null itself.
        missing = np.nan if meta.kept_in == "data" else None
        values = np.full(meta.chunks, missing if meta.fill is None else meta.fill, dtype=None if kind == "int64" else kind)
    else:
        values = np.frombuffer(_decompress(content, meta), dtype=meta.dtype)
        if values.dtype.kind == "S":
            values = np.char.decode(values, "utf-8")
        values = values.reshape(meta.chunks, order=meta.order)
    rows, columns = _spans(meta, cut)
    start, column = i * meta.chunks[0], 0
    values = values[max(rows[0] - start, 0) : max(rows[1] - start, 0)]
    start = max(start, rows[0])
    if values.ndim > 1:
        column = j * meta.chunks[1]
        values = values[:, max(columns[0] - column, 0) : max(columns[1] - column, 0)]
        column = max(column, columns[0])
    if content is not None:
        values = values.astype(kind)
    at = 0
    while at < len(values):
        block, inside = divmod(start + at, BLOCK_ROWS)
        take = min(BLOCK_ROWS - inside, len(values) - at)
        yield {
            "variable": meta.name,
            "block": block,
            "row": inside,
            "column": column,
            "width": values.shape[1] if values.ndim > 1 else 1,
            **{field: None for field in ("data", "ints", "texts")},
            meta.kept_in: values[at : at + take].reshape(-1).tolist(),
        }
        at += take


PIECES = (
    "variable string, block bigint, row int, column int, width int, data array<double>, ints array<bigint>,"
    " texts array<string>"
)


def decode_chunks(
    spark: SparkSession, root: str, metas: list[ArrayMeta], cut: Mapping[str, Span] | None = None
) -> DataFrame:
    """Pieces ``(variable, block, row, column, width, data, ints, texts)`` of the variables.

    A variable's values lie in the one field that fits its type. ``cut`` keeps a span
    of indexes of each dimension it names; chunks outside are neither listed nor opened.
    """
    cut = dict(cut or {})
    by_name = {m.name: m for m in metas}
    needed = {m.name: _chunks_of(m, cut) for m in metas}
    needed = {name: spans for name, spans in needed.items() if all(a < b for a, b in spans)}
    if not needed:
        return spark.createDataFrame([], PIECES)
    folders: dict[str, list[str]] = {}
    for name in needed:
        folders.setdefault(_name_glob(by_name[name], cut), []).append(f"{root}/{name}")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reduce(
        DataFrame.unionByName, [source.option("pathGlobFilter", glob).load(paths) for glob, paths in folders.items()]
    )
    parts = F.split(F.col("path"), "/")
    chunk = F.split(F.element_at(parts, -1), r"\.")
    named = files.select(
        F.element_at(parts, -2).alias("variable"),
        F.element_at(chunk, 1).try_cast("bigint").alias("i"),
        F.coalesce(F.try_element_at(chunk, F.lit(2)).try_cast("bigint"), F.lit(0).cast("bigint")).alias("j"),
        "content",
    ).where(F.col("i").isNotNull())
    shapes = spark.createDataFrame(
        [(name, i[0], i[1] - 1, j[0], j[1] - 1) for name, (i, j) in needed.items()],
        "variable string, i_first bigint, i_last bigint, j_first bigint, j_last bigint",
    )
    expected = shapes.select("variable", "j_first", "j_last", F.explode(F.sequence("i_first", "i_last")).alias("i"))
    expected = expected.select("variable", "i", F.explode(F.sequence("j_first", "j_last")).alias("j"))
    # Only names are compared, so the contents are not read here.
    missing = expected.join(named.select("variable", "i", "j"), ["variable", "i", "j"], "left_anti")
    todo = named.unionByName(missing.withColumn("content", F.lit(None).cast("binary")))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pieces = list(_chunk_blocks(by_name[row.variable], int(row.i), int(row.j), row.content, cut))
                if pieces:
                    yield pd.DataFrame(pieces)

    return todo.mapInPandas(decode, PIECES)


def read_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """``variable, dimension, index, value, text`` of the one-dimensional variables that do not lie along time.

    A variable named like its dimension holds that dimension's coordinates. Numbers
    are in ``value`` (whole ones too), text in ``text``.
    """
    metas = [m for m in read_metadata(spark, root) if len(m.shape) == 1 and m.dims and m.dims[0] != "time"]
    schema = "variable string, dimension string, index bigint, value double, text string"
    if not metas:
        return spark.createDataFrame([], schema)
    along = F.create_map(*[F.lit(x) for m in metas for x in (m.name, m.dims[0])])
    numbers = F.coalesce("data", F.col("ints").cast("array<double>"))
    items = F.coalesce(
        F.transform(numbers, lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("text"))),
        F.transform("texts", lambda t: F.struct(F.lit(None).cast("double").alias("value"), t.alias("text"))),
    )
    pieces = decode_chunks(spark, root, metas)
    rows = pieces.select("variable", "block", "row", F.posexplode(items).alias("at", "item"))
    index = F.col("block") * F.lit(BLOCK_ROWS) + F.col("row") + F.col("at")
    return rows.select("variable", along[F.col("variable")].alias("dimension"), index.alias("index"), "item.*")


def _index_spans(
    spark: SparkSession, root: str, metas: list[ArrayMeta], ranges: Mapping[str, tuple]
) -> dict[str, Span]:
    """From the first index of each dimension whose coordinate lies in its range to the last; one job, one row each."""
    own = {m.name: m for m in metas if len(m.shape) == 1 and m.dims[:1] == (m.name,)}
    edges = []
    for dimension, (low, high) in ranges.items():
        if dimension not in own:
            raise ValueError(f"'{dimension}' has no coordinates in this group")
        m = own[dimension]
        pieces = decode_chunks(spark, root, [m])
        items = pieces.select("block", "row", F.posexplode(m.kept_in).alias("at", dimension))
        value = _clean(m)
        if dimension == "time":
            value = decode_time(value, *_calendar(m))
            low, high = (None if x is None else F.lit(x).cast("timestamp") for x in (low, high))
        inside = F.lit(True)
        inside = inside if low is None else inside & (value >= low)
        inside = inside if high is None else inside & (value <= high)
        index = F.col("block") * F.lit(BLOCK_ROWS) + F.col("row") + F.col("at")
        found = items.where(inside & value.isNotNull()).agg(F.min(index).alias("a"), F.max(index).alias("b"))
        edges.append(found.select(F.lit(dimension).alias("dimension"), "a", "b"))
    found = reduce(DataFrame.unionByName, edges).collect()
    return {r["dimension"]: (0, 0) if r["a"] is None else (r["a"], r["b"] + 1) for r in found}


def _calendar(time: ArrayMeta) -> tuple[str, str]:
    return time.attrs.get("units", DEFAULT_UNITS), time.attrs.get("calendar", DEFAULT_CALENDAR)


def read_arrays(spark: SparkSession, root: str, ranges: Mapping[str, tuple] | None = None) -> DataFrame:
    """A group as a stream table: ``_pos``, ``time`` decoded, one column per variable.

    Two-dimensional variables become array columns; NaN becomes null; whole numbers
    and text keep their type. ``ranges`` cuts dimensions by their coordinates, time
    included, and only the chunks that are needed are read: ``{"wavelength": (400, 500),
    "time": ("2024-01-01", None)}`` keeps what lies from the first coordinate inside to
    the last; None leaves a side open. ``_pos`` is the position in the whole group. A
    range without any coordinate gives no rows for time, empty arrays for another dimension.
    ``read_coordinates`` gives the variables that do not lie along time.
    """
    every = read_metadata(spark, root)
    metas = [m for m in every if m.dims[:1] == ("time",)]
    time = next((m for m in metas if m.name == "time"), None)
    if time is None:
        raise ValueError(f"{root} has no 'time' variable")
    cut = _index_spans(spark, root, every, ranges) if ranges else {}
    empty = {m.name for m in metas if len(m.shape) > 1 and _spans(m, cut)[1][0] >= _spans(m, cut)[1][1]}
    read = [m for m in metas if m.name not in empty]
    pieces = decode_chunks(spark, root, read, cut)
    columns = []
    for m in read:
        values = F.col(m.kept_in).alias("data")
        mine = F.when(F.col("variable") == m.name, F.struct("column", "row", "width", values))
        columns.append(F.array_sort(F.collect_list(mine)).alias(m.name))
    # At most one block of each variable meets in a group.
    blocks = pieces.groupBy("block").agg(*columns)
    aligned = blocks.select(
        "block", F.array_min(F.col("time")["row"]).alias("_first"), *[_block_rows(m, cut).alias(m.name) for m in read]
    )
    zipped = F.posexplode(F.arrays_zip(*[m.name for m in read])).alias("_row", "_z")
    rows = aligned.select("block", "_first", zipped).select(
        (F.col("block") * F.lit(BLOCK_ROWS) + F.col("_first") + F.col("_row")).alias("_pos"),
        *[F.col("_z")[m.name].alias(m.name) for m in read],
    )
    types = {"data": "array<double>", "ints": "array<bigint>", "texts": "array<string>"}
    return rows.select(
        "_pos",
        decode_time(_clean(time), *_calendar(time)).alias("time"),
        *[
            (F.array().cast(types[m.kept_in]) if m.name in empty else _clean(m)).alias(m.name)
            for m in metas
            if m.name != "time"
        ],
    )


def _block_rows(m: ArrayMeta, cut: Mapping[str, Span]):
    """The pieces of one variable in a block as one array with an entry per row."""
    pieces = F.col(m.name)
    if len(m.shape) == 1:
        return F.flatten(F.transform(pieces, lambda p: p["data"]))
    # Pieces are ordered by column, then row. Those of the first column begin the rows; the
    # others of the same rows are looked up once for all of these.
    first = F.lit(_spans(m, cut)[1][0])

    def piece_rows(begin):
        beside = F.filter(pieces, lambda p: p["row"] == begin["row"])
        n = (F.size(begin["data"]) / begin["width"]).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.flatten(F.transform(beside, lambda p: F.slice(p["data"], k * p["width"] + 1, p["width"]))),
        )

    return F.flatten(F.transform(F.filter(pieces, lambda p: p["column"] == first), piece_rows))


def _clean(m: ArrayMeta):
    if m.kept_in != "data":
        return F.col(m.name)
    if len(m.shape) == 1:
        return nan_to_null(F.col(m.name))
    return F.transform(F.col(m.name), nan_to_null)
