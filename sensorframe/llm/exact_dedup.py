"""Exact duplicates by a tree merge of sorted digest runs.

Every text is digested once. Each slot holds a sorted run with one record per
digest: the smallest identifier and the number of rows. In round ``r`` a slot
exchanges parts of its run with the slots that differ from it in digit ``r`` of
their number only; part ``j`` of the digest range goes to the slot whose digit is
``j``. The runs a slot receives are merged, equal digests into one record. After
the last round slot ``s`` holds the whole of digest range ``s``, so no round brings
more than a range together, and a large group of copies shrinks to one record a
run before anything is exchanged.

Runs are streamed. A digest range is cut into pages; a slot reads page after page, in
each one run after the other, and merges the runs of a page before it reads the next.
Spark orders the pages and runs of a slot, and spills where it must, so a task
holds one page, whatever the size of a slot. The number of slots follows the rows.

Digests are verified at every merge: records are one only if the SHA-256, the
length and a second independent hash of the text agree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import stored

FAN = 4
SLOT_ROWS = 200_000
#: Pages of a slot; one holds about SLOT_ROWS / PAGES distinct texts, with a record for each run that has it.
PAGES = 64
FRAME_ROWS = 10_000
KEY = ("digest", "size", "check")
BEST = ("no_id", "id", "row")
RUN = "slot bigint, page bigint, run bigint, digest string, size bigint, check bigint, no_id int, id bigint, row bigint, n bigint"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per input row, numbered in ``row``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return rows.select(
        "doc_id",
        F.sha2("text", 256).alias("digest"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.xxhash64("text").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One sorted run of ``(digest, size, check, no_id, id, row, n)`` from several.

    Records with the same verified digest become one with the smallest identifier
    and the sum of their rows.
    """
    last = None
    for record in heapq.merge(*runs):
        if last is not None and record[:3] == last[:3]:
            last = (*last[:6], last[6] + record[6])
        else:
            if last is not None:
                yield last
            last = record
    if last is not None:
        yield last


def merged_pages(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One sorted run for each slot, from rows ``(slot, page, run, *record)`` in this order.

    The new run has the number of its slot. Only the records of one page are held.
    """
    for (slot, page), of_page in groupby(rows, itemgetter(0, 1)):
        runs = [[row[3:] for row in of_run] for _, of_run in groupby(of_page, itemgetter(2))]
        for record in merge_runs([iter(run) for run in runs]):
            yield (slot, page, slot, *record)


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in batch.columns))


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(part, columns=["slot", "page", "run", *KEY, *BEST, "n"])


def smallest(found: DataFrame, slots: int, fan: int = FAN, pages: int = PAGES) -> DataFrame:
    """One record per distinct text of ``digests`` rows; ``slots`` is a power of ``fan``."""
    rounds = round(math.log(slots, fan))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    area = F.floor(place * slots / F.lit(2.0**32)).cast("bigint")
    task = F.spark_partition_id().cast("bigint")
    first = found.select(
        F.pmod(task, F.lit(slots)).alias("slot"),
        F.floor(place * F.lit(float(slots * pages)) / F.lit(2.0**32)).cast("bigint").alias("page"),
        task.alias("run"),
        "digest",
        "size",
        "check",
        F.col("doc_id").isNull().cast("int").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"),
        "row",
        F.lit(1).cast("bigint").alias("n"),
    )

    def build(batches):
        """One sorted run of a task's own rows; it has the number of the task."""
        for (slot, page, run), rows in groupby(_rows(batches), itemgetter(0, 1, 2)):
            yield from ((slot, page, run, *record) for record in merge_runs([(row[3:] for row in rows)]))

    order = ("page", "run", *KEY, *BEST)
    runs = first.sortWithinPartitions(*order).mapInPandas(lambda batches: _frames(build(batches)), RUN)
    for digit in range(rounds):
        step = fan**digit
        own = F.floor(F.col("slot") / step) % fan
        wanted = F.floor(area / step) % fan
        sent = runs.withColumn("slot", (F.col("slot") + (wanted - own) * step).cast("bigint"))
        dealt = sent.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", *order)
        runs = dealt.mapInPandas(lambda batches: _frames(merged_pages(_rows(batches))), RUN)
    return runs


def slots_for(rows: int, fan: int, slot_rows: int) -> int:
    """The power of ``fan`` with ``slot_rows`` rows a slot at most."""
    slots = fan
    while slots * slot_rows < rows:
        slots *= fan
    return slots


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Groups of equal texts: ``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when they agree after each run of ASCII white space is one
    space; null counts as empty. The row with the smallest integer id stays; a null
    id comes after all others, and of several rows with the same id and text the
    first read stays, so exactly one row of each group has ``kept``. An empty table
    gives no rows.
    """
    found = stored(digests(docs, id_col, text_col))
    slots = slots_for(found.count(), fan, slot_rows)
    best = smallest(found, slots, fan).select(
        *KEY,
        F.when(F.col("no_id") == 0, F.col("id")).alias("keep_id"),
        F.col("row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    return found.join(best, list(KEY)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
