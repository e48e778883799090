"""The record of a stored stream: rows, extent, sizes, and the order of its samples.

It is taken while the stream is written (observed metrics of the write itself) and
lies beside the data, so that sizes, coverage and order need no scan later.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.cftime import to_micros
from sensorframe.functions.values import value_bytes
from sensorframe.operators.neighbours import with_neighbours

#: Below the folder of the stream; readers of the data pass over names that begin with "_".
FOLDER = "_statistics"
#: Bits of a microsecond below a bucket of the order check, about 18 minutes.
_BUCKET = 30

SCHEMA = (
    "rows bigint, first_time timestamp_ntz, last_time timestamp_ntz, ordered boolean, unique boolean, "
    "variables array<struct<variable:string,dtype:string,n_present:bigint,n_values:bigint,n_bytes:bigint>>"
)


@dataclass(frozen=True)
class Variable:
    variable: str
    dtype: str
    #: Rows with a value, values (elements of arrays; else rows), and bytes of all values.
    n_present: int
    n_values: int
    n_bytes: int


@dataclass(frozen=True)
class StreamStatistics:
    rows: int
    first_time: datetime | None
    last_time: datetime | None
    #: Positions grow with time, so that a range of time is a range of positions.
    ordered: bool
    #: No two samples share an instant.
    unique: bool
    variables: tuple[Variable, ...]

    def bytes_of(self, names) -> int:
        wanted = set(names)
        return sum(v.n_bytes for v in self.variables if v.variable in wanted)


def _metrics(fields: Sequence[T.StructField], time: str) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")]
    for i, f in enumerate(fields):
        out += [F.count(f.name).alias(f"c{i}"), F.coalesce(F.sum(value_bytes(f)), F.lit(0)).alias(f"b{i}")]
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.coalesce(F.sum(F.coalesce(F.size(f.name), F.lit(0)).cast("bigint")), F.lit(0)).alias(f"n{i}"))
    return out


def observed(df: DataFrame, fields: Sequence[T.StructField], time: str) -> tuple[DataFrame, Observation]:
    """``df``, and the observation of the ``fields`` that its write fills."""
    seen = Observation()
    return df.observe(seen, *_metrics(fields, time)), seen


def order_of(samples: DataFrame, time: str, position: str | None) -> tuple[bool, bool]:
    """``(ordered, unique)`` of the samples, exactly; without a position they are as ordered as their time.

    Samples of one instant are added up before they are shuffled, and instants meet in
    buckets of time, with one edge from each bucket to the next. Samples without a time
    take no part.
    """
    place = F.col(position).cast("bigint") if position else F.lit(0).cast("bigint")
    rows = samples.where(F.col(time).isNotNull()).select(to_micros(F.col(time)).alias("_t"), place.alias("_p"))
    instants = rows.groupBy("_t").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_low"), F.max("_p").alias("_high")
    )
    linked = with_neighbours(
        instants.withColumn("_bucket", F.shiftright("_t", _BUCKET)), [], "_bucket", "_t", previous={"_before": F.col("_high")}
    )
    found = linked.agg(F.bool_or(F.col("_before") > F.col("_low")).alias("back"), F.max("_n").alias("most")).first()
    return not found["back"], (found["most"] or 0) <= 1


def write_statistics(spark: SparkSession, path: str, fields: Sequence[T.StructField], seen: dict, ordered: bool, unique: bool) -> None:
    variables = []
    for i, f in enumerate(fields):
        n_values = seen.get(f"n{i}", seen["rows"])
        variables.append((f.name, f.dataType.simpleString(), seen[f"c{i}"], n_values, seen[f"b{i}"]))
    row = (seen["rows"], seen["first"], seen["last"], ordered, unique, variables)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{FOLDER}")


def read_statistics(spark: SparkSession, path: str) -> StreamStatistics | None:
    """The record of a stored stream, or None for one that was written without."""
    try:
        row = spark.read.schema(SCHEMA).parquet(f"{path}/{FOLDER}").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None:
        return None
    variables = tuple(Variable(*v) for v in row["variables"])
    return StreamStatistics(row["rows"], row["first_time"], row["last_time"], row["ordered"], row["unique"], variables)
