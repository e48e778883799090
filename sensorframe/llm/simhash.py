"""Near-duplicates by SimHash and a range join on segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments. The
Manhattan distance of two such vectors is never more than the Hamming distance
of the fingerprints. With at most ``k`` differing bits, the vectors of one half
are at most ``k // 2`` apart. Every fingerprint is entered, for each half, in the
grid cell of its vector and in all cells one step away: two vectors at most two
steps apart then share a cell. The fingerprints of a cell are compared exactly.

Only distinct fingerprints are joined, and a cell gives a forest that connects what
is linked in it, not all its pairs. Cells of more than ``CELL_ROWS`` fingerprints are
dealt into blocks, and every two blocks are compared in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.components import components
from sensorframe.llm.tables import free_name, stored

SEED = 42
CELL_ROWS = 20_000
SMALL_CELL = 32
SHINGLES_AT_ONCE = 500_000
FOUND = "a bigint, b bigint, cell bigint"


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, of all words if there are fewer; A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - size + 1
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[size - 1 :].tolist())]


def _bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        values = np.array(hashes[i : i + SHINGLES_AT_ONCE], "<u8")
        total += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, size: int) -> int:
    """Bit ``i`` is set if it is set in more than half of the hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, size)
    bits = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(doc_id, doc, fp)``: one row per input row.

    ``fp`` holds the 64 bits as a signed integer; ``doc`` is a hash of id and text.
    """

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "doc": batch["doc"], "fp": values.astype(np.int64)})

    # Ids travel as text: integers beside nulls would become floats in pandas.
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        row_key(id_col, text_col).alias("doc"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    found = rows.mapInPandas(run, "doc_id string, doc bigint, fp bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments of two bits."""
    pairs = np.arange(0, 64, 2, dtype=np.uint64)
    two = (fps.astype(np.uint64)[:, None] >> pairs) & np.uint64(3)
    return ((two & np.uint64(1)) + (two >> np.uint64(1))).astype(np.int64)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every cell that each fingerprint is entered in: positions in ``fps`` and cell numbers."""
    counts = segment_counts(fps)
    place = 4 ** np.arange(16, dtype=np.int64)
    rows, out = [], []
    for half in range(2):
        mine = counts[:, 16 * half : 16 * half + 16]
        own = (mine * place).sum(axis=1) + (half << 32)
        rows.append(np.arange(len(fps)))
        out.append(own)
        for step in (1, -1):
            at, segment = np.nonzero(mine < 2 if step > 0 else mine > 0)
            rows.append(at)
            out.append(own[at] + step * place[segment])
    return np.concatenate(rows), np.concatenate(out)


def _near(a: np.ndarray, b, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fps: np.ndarray, distance: int, split: int | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect all fingerprints which links connect; one less than those at most.

    With ``split``, only links between the first ``split`` and the others are used.
    """
    left = np.arange(len(fps))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = _near(fps[left], fps[one], distance)
            if split is not None:
                near &= (left < split) != (one < split)
            for other in left[near].tolist():
                yield int(fps[one]), int(fps[other])
                reached.append(other)
            left = left[~near]


def _small_cells(cell: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of sorted rows whose cells are small."""
    out_a, out_b = [], []
    at, lag = np.arange(len(cell)), 1
    while True:
        at = at[at + lag < len(cell)]
        at = at[cell[at] == cell[at + lag]]
        if not len(at):
            break
        near = _near(fps[at], fps[at + lag], distance)
        out_a.append(fps[at[near]])
        out_b.append(fps[at[near] + lag])
        lag += 1
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _cell_links(batches, distance: int, cell_rows: int) -> Iterator[pd.DataFrame]:
    """Links of cells that come in order; rows of cells that are too large come back with their cell."""
    rest_cell, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    late = None  # a large cell of which rows were already given back

    def links(cell: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        few = sizes <= SMALL_CELL
        if late is not None:
            few &= cell[starts] != late
        small = np.repeat(few, sizes)
        a, b = _small_cells(cell[small], fps[small], distance)
        found = pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)}).drop_duplicates()
        yield found.assign(cell=pd.Series([pd.NA] * len(found), dtype="Int64", index=found.index))
        for start, size in zip(starts[~few].tolist(), sizes[~few].tolist()):
            mine = fps[start : start + size]
            if size > cell_rows or cell[start] == late:
                yield large(mine, int(cell[start]))
            else:
                pairs = np.array(list(forest(mine, distance)), np.uint64).reshape(-1, 2).astype(np.int64)
                found = pd.DataFrame(pairs, columns=["a", "b"])
                yield found.assign(cell=pd.Series([pd.NA] * len(found), dtype="Int64"))

    def large(fps: np.ndarray, cell: int) -> pd.DataFrame:
        return pd.DataFrame({"a": fps.astype(np.int64), "b": fps.astype(np.int64), "cell": cell})

    for batch in batches:
        cell = np.concatenate([rest_cell, batch["cell"].to_numpy()])
        fps = np.concatenate([rest_fp, batch["fp"].to_numpy().astype(np.uint64)])
        if not len(cell):
            continue
        whole = int(np.searchsorted(cell, cell[-1]))
        yield from links(cell[:whole], fps[:whole])
        rest_cell, rest_fp = cell[whole:], fps[whole:]
        if len(rest_fp) > cell_rows or rest_cell[0] == late:
            late = int(rest_cell[0])
            yield large(rest_fp, late)
            rest_cell, rest_fp = rest_cell[:0], rest_fp[:0]
    if len(rest_fp) and rest_cell[0] == late:
        yield large(rest_fp, late)
    else:
        yield from links(rest_cell, rest_fp)


def _large_cells(found: DataFrame, distance: int, cell_rows: int) -> DataFrame | None:
    """Links of the cells that were given back: every two blocks of a cell meet in one task."""
    given = found.filter("cell is not null").select("cell", F.col("a").alias("fp"))
    sizes = given.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return None
    # Every cell in as many blocks as its own size asks for.
    sized = given.join(sizes, "cell").withColumn("blocks", (F.ceil(F.col("n") / cell_rows) * 2).cast("bigint"))
    mine = sized.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    meet = mine.select("cell", "fp", "block", other)
    meet = meet.select("cell", "fp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "fp"], kind="stable")
        fps = frame["fp"].to_numpy().astype(np.uint64)
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        split = None if low == high else int((frame["block"] == low).sum())
        pairs = np.array(list(forest(fps, distance, split)), np.uint64).reshape(-1, 2).astype(np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return meet.groupBy("cell", "low", "high").applyInPandas(pair, "a bigint, b bigint")


def links(classes: DataFrame, distance: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that connect all that are ``distance`` bits apart or less."""
    if not 0 <= distance <= 5:
        raise ValueError("the grid finds at most 5 differing bits")

    def enter(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                rows, cell = cells(part)
                yield pd.DataFrame({"cell": cell, "fp": part[rows]})

    def compare(batches):
        return _cell_links(batches, distance, cell_rows)

    entered = classes.select("fp").mapInPandas(enter, "cell bigint, fp bigint")
    ordered = entered.repartition("cell").sortWithinPartitions("cell")
    found = stored(ordered.mapInPandas(compare, FOUND))
    out = found.filter("cell is null").select("a", "b")
    more = _large_cells(found, distance, cell_rows)
    return out if more is None else out.union(more)


def near_duplicates(
    docs: DataFrame,
    size: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Documents are linked when their fingerprints differ in ``distance`` bits or
    fewer; ``component_id`` is the smallest id that links reach. A null or empty
    text, and one of white space only, has fingerprint zero, and is linked like any
    other. Null ids are never the smallest, unless all ids of a component are null.
    Repeated rows come back as often. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, size))
    rooted = _rooted(rows, distance, cell_rows, F.min("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(rows: DataFrame, distance: int, cell_rows: int, least: Column) -> DataFrame:
    """``(fp, least, root)`` of every distinct fingerprint."""
    classes = stored(rows.groupBy("fp").agg(least.alias("least")))
    roots = components(links(classes, distance, cell_rows))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stored(grouped.select("fp", "least", F.coalesce("root", "fp").alias("root")))


def representatives(
    docs: DataFrame,
    size: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, columns as they are.

    Null ids come after all others; of rows that repeat an id, the one with the
    smallest hash of its text stays, and of equal rows one.
    """
    rows = stored(fingerprints(docs, id_col, text_col, size))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc"))
    rooted = _rooted(rows, distance, cell_rows, order)
    key = free_name(docs.columns)
    number = free_name([*docs.columns, key])
    kept = stored(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc").alias(key)))
    marked = docs.withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi")
    one = Window.partitionBy(key).orderBy(key)
    return marked.withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1).select(docs.columns)
