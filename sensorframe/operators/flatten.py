"""n-d variables to long rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_arrays(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    index: str = "index",
    dims: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per element of the array columns; scalars repeat. No join and no shuffle.

    Arrays of one dimension are read side by side; shorter ones are null past
    their end. A row whose arrays are all null or empty stays, with a null index.
    ``dims`` names the dimension of each array (``index`` where it names none): arrays
    of different dimensions are combined, every element with every other of the row.
    """
    arrays = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)])
    groups: dict[str, list[str]] = {}
    for name in arrays:
        groups.setdefault((dims or {}).get(name, index), []).append(name)
    out = df
    for dimension, names in groups.items():
        present = [F.coalesce(F.col(n), F.array().cast(df.schema[n].dataType)).alias(n) for n in names]
        rest = [c for c in out.columns if c not in names]
        zipped = F.posexplode_outer(F.arrays_zip(*present)).alias(dimension, "_z")
        out = out.select(*rest, zipped).select(*rest, dimension, *[F.col("_z")[n].alias(n) for n in names])
    scalars = [c for c in df.columns if c not in arrays]
    return out.select(*scalars, *groups, *arrays)
