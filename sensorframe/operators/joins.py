"""Join helpers: size-checked broadcast with a salted way beyond it, null-safe keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.session import materialize

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``small`` against both bounds, by sums that every task makes of its own rows."""
    size = small.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
    ).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def sized_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    fits: bool | None = None,
    costly: bool = False,
) -> DataFrame:
    """Equi join (``inner`` or ``left``) that survives a hot key on the ``big`` side.

    ``small`` is broadcast when its measured size allows. Otherwise the rows of
    ``big`` are spread over salts and ``small`` is repeated once per salt, so no
    key is handled by a single task. The key columns of ``small`` are dropped.
    ``condition`` may add a predicate on the remaining columns. ``fits`` gives a
    measurement made before; a ``costly`` small side is stored first, so that
    measuring it does not compute it twice.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    small = materialize(small) if costly else small
    right = small.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = condition if condition is not None else F.lit(True)
    for key in keys:
        on = F.col(key).eqNullSafe(F.col(f"_right_{key}")) & on
    if fits if fits is not None else fits_broadcast(small):
        joined = big.join(F.broadcast(right), on, how)
    else:
        salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        right = right.withColumn("_right_salt", copies)
        joined = salted.join(right, on & (F.col("_salt") == F.col("_right_salt")), how).drop("_salt", "_right_salt")
    return joined.drop(*[f"_right_{k}" for k in keys])


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on same-named keys; Spark picks the strategy from run-time sizes.

    Plain equality keeps the partitioning a window or aggregate on the same keys
    has already made.
    """
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_right_{k}") for k in keys]
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])
