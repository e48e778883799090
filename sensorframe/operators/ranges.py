"""Range-partitioned order: exact row numbers and skew-proof buckets for any sort key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.cftime import to_micros
from sensorframe.operators.joins import sized_join
from sensorframe.operators.neighbours import running_totals
from sensorframe.session import materialize

# Rows of a range partition: partitions grow in number, not in size.
ROWS_PER_PARTITION = 2_000_000
# monotonically_increasing_id: partition number above, row number in the lower 33 bits.
_ROW_BITS = 33
# Before all times.
_FIRST = -(1 << 62)


def range_ordered(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "_place",
    partitions: int | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """Sort ``df`` into balanced range partitions and number the rows in order.

    ``name`` grows with the order and ``bucket_of(name)`` is the partition. Ties
    are split by the input position, so even a group of identical rows spreads
    over several partitions. The result is written to the shared folder because
    the numbers depend on the sampled partition bounds. Without a number of
    ``partitions`` the rows are counted, and no partition is planned with more than
    ``rows_per_partition``.
    """
    spark = df.sparkSession
    n = partitions
    if n is None:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_partition))
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()))


def bucket_of(place: str) -> Column:
    return F.shiftright(F.col(place), _ROW_BITS)


def row_index(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index", partitions: int | None = None
) -> DataFrame:
    """Exact 0-based row number over the whole table, without a single-task window.

    Only one count per partition reaches the driver.
    """
    placed = range_ordered(df, order_by, "_place", partitions)
    bucket = bucket_of("_place")
    counts = placed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["bucket"]: r["n"] for r in counts}
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("bigint")).drop("_place")
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), (bucket + 1).cast("int"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, start + inside).drop("_place")


def row_slices(df: DataFrame, order_by: Sequence[str | Column], rows_per_slice: int, partitions: int | None = None):
    """Row index plus the number of the contiguous slice each row falls in."""
    indexed = row_index(df, order_by, "row_index", partitions)
    slice_id = F.floor(F.col("row_index") / F.lit(rows_per_slice)).cast("bigint")
    return indexed.withColumn("slice_id", slice_id)


# Buckets of the table that maps times to slices; it is broadcast.
_LOOKUP_BUCKETS = 50_000


def with_slices(df: DataFrame, time: str, rows_per_slice: int, name: str = "slice_id") -> DataFrame:
    """Number the contiguous slices of ``rows_per_slice`` rows in time order, without moving the rows.

    Rows are added up by instant, and running totals tell at which instants a slice
    begins; every row then looks its slice up by time. Only where a slice
    begins among rows of one instant are those rows numbered one by one (in an order of
    their own). Rows without a time come first.
    """
    spark = df.sparkSession
    t = F.coalesce(to_micros(F.col(time)), F.lit(_FIRST))
    span = df.agg(F.min(to_micros(F.col(time))).alias("low"), F.max(to_micros(F.col(time))).alias("high")).first()
    width = 0 if span["low"] is None else span["high"] - span["low"]
    bits = max((width // _LOOKUP_BUCKETS).bit_length(), 20)
    instants = df.groupBy(t.alias("_t")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.shiftright("_t", bits))
    totals = running_totals(instants, [], "_bucket", "_t", {"_before": F.col("_n")})
    step = F.lit(rows_per_slice).cast("bigint")
    first, last = F.call_function("div", F.col("_before"), step), F.call_function("div", F.col("_before") + F.col("_n") - 1, step)
    placed = materialize(totals.select("_t", "_bucket", "_n", "_before", first.alias("_first"), last.alias("_last")))

    # An instant begins a new slice if its first row does; one bucket holds its first slice and the later beginnings.
    begins = placed.where((F.col("_before") % step == 0) | (F.col("_first") < F.col("_last")))
    starts = begins.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("_t", "_last"))).alias("_starts"))
    lookup = placed.groupBy("_bucket").agg(F.min("_first").alias("_base")).join(starts, "_bucket", "left")
    split = placed.where("_first < _last").select("_t", "_n", "_before")
    staged = df.withColumns({"_t": t, "_bucket": F.shiftright(t, bits)})
    found = staged.join(F.broadcast(lookup), "_bucket").withColumn("_upto", F.filter("_starts", lambda s: s["_t"] <= F.col("_t")))
    slices = F.coalesce(F.get("_upto", F.size("_upto") - 1)["_last"], F.col("_base"))
    whole = found.withColumn(name, slices)
    if split.isEmpty():
        return whole.select(*df.columns, name)
    cut = materialize(split)
    tied = sized_join(staged, cut, ["_t"])
    # At most one of them a slice.
    rest = whole.join(F.broadcast(cut.select(F.col("_t").alias("_cut"))), F.col("_t") == F.col("_cut"), "left_anti").select(*df.columns, name)
    numbered = row_index(tied, ["_t"], "_row")
    skipped = running_totals(cut.withColumn("_bucket", F.shiftright("_t", bits)), [], "_bucket", "_t", {"_skipped": F.col("_n")})
    numbered = sized_join(numbered, skipped.select("_t", "_skipped"), ["_t"], costly=True)
    row = F.col("_before") + F.col("_row") - F.col("_skipped")
    return rest.unionByName(numbered.withColumn(name, F.call_function("div", row, step)).select(*df.columns, name))
