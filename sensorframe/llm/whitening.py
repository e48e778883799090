"""Whitening of embeddings; components by spectral divide-and-conquer with QDWH.

Spark adds up the rows (whole numbers, exactly), then the centred products. The
covariance is split on the driver: the polar factor of the covariance less a shift,
found by dynamically weighted Halley steps, is +1 on the components above the shift and
-1 on those below. The two projectors give two invariant subspaces, which are split in the same way
until each holds one component. The matrix that whitens is broadcast. Only sums reach
the driver; their size is that of a vector, squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import Shared, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Sums of ten thousand whole numbers stay within 64 bits up to here.
LARGEST = 2.0**36


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal factor of a symmetric matrix by QR-based QDWH steps; None if it is all but singular."""
    size = np.linalg.norm(a)
    if size == 0:
        return None
    x = a / size
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return None
    if not low > 1e-13:
        return None
    one = np.eye(len(a))
    for _ in range(40):
        before = x
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        x = q / r * x + (p - q / r) / np.sqrt(r) * both[: len(a)] @ both[len(a) :].T
        x = (x + x.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        if np.linalg.norm(x - before) < 1e-14 * len(a) and 1 - low < 1e-12:
            break
    return x


def _halves(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the components above and below some shift between the eigenvalues of ``a``."""
    mean, spread = np.trace(a) / len(a), np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a)))
    # The mean lies between the eigenvalues; the median halves them better where it does too.
    for shift in (np.median(np.diag(a)), mean, *(mean + spread / len(a) * rng.uniform(-0.5, 0.5, 8))):
        factor = polar(a - shift * np.eye(len(a)))
        if factor is None:
            continue
        projector = (np.eye(len(a)) + factor) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < len(a):
            continue
        basis = rng.normal(size=(len(a), rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(basis, mode="complete")
        return basis, whole[:, rank:]
    return None


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; equal ones get any basis."""
    rng = np.random.default_rng(0)
    scale = np.linalg.norm(v)
    todo, values, vectors = [(v, np.eye(len(v)))], [], []
    while todo:
        a, basis = todo.pop()
        off = np.linalg.norm(a - np.diag(np.diag(a)))
        parts = None if len(a) == 1 or off <= 4e-16 * scale else _halves(a, rng)
        if parts is None:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            continue
        for part in parts:
            inner = part.T @ a @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order].T.reshape(len(v), len(order))


def _usable(c: Column) -> Column:
    return F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x array<bigint>)`` of the rows whose vector has no null and no entry that is not finite."""
    c = F.col(vector_col).cast("array<double>")
    in_range = F.forall(c, lambda v: F.abs(v) < LARGEST)
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT)
    rows = vectors.filter(_usable(c)).select(
        F.col(id_col).alias("vec_id"), F.when(F.assert_true(in_range, F.lit("an entry is out of range")).isNull(), x).alias("x")
    )
    return rows


def _matrix(x: pd.Series, d: int) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(-1, d)


def _summed(parts: DataFrame, size: int, kind) -> list:
    total = [kind(0)] * size
    for row in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[row["at"]] = kind(row["v"])
    return total


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Coordinates of every vector along the leading components, each with variance one.

    ``(vec_id, component int, n, deviation decimal(38,0), whitened, explained,
    identity_error)``, one row for each vector that stays and component 1 to
    ``components`` (fewer if vectors are shorter). An entry c counts as x = floor(1024 c) +
    100000. ``deviation`` is the exact sum over dimensions of (n x - S)^2, S the sum of
    x; ``explained`` is the component's share of all variance; ``identity_error`` is the largest
    absolute entry of the covariance of ``whitened`` less the identity, measured on all rows.

    Rows whose vector is null or holds a null, a NaN or an infinity are left out; null
    ids stay, and repeated rows count each. A component without variance (equal rows,
    fewer rows than components) has null ``whitened``, and is left out of ``identity_error``,
    which is null if no component is left; ``explained`` is null where nothing varies. Vectors of different
    lengths, and entries of 2^36 or more, are an error. An empty table, or vectors of
    length 0, give no rows. Other columns are not read.
    """
    rows = stored(whole_numbers(vectors, id_col, vector_col))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("d")).first()
    n, d = found["n"], found["d"] or 0
    if found["low"] != found["d"]:
        raise ValueError(f"vectors have {found['low']} to {found['d']} entries")
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if n == 0 or d == 0:
        return vectors.sparkSession.createDataFrame([], out)

    def sums(batches):
        total = np.zeros(d, object)
        for batch in batches:
            total += _matrix(batch["x"], d).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(d), "v": [str(t) for t in total]})

    parts = rows.select("x").mapInPandas(sums, "at int, v string")
    total = _summed(parts.select("at", F.col("v").cast("decimal(38,0)").alias("v")), d, int)
    base = np.array([t // n for t in total], np.int64)
    rest = [t % n for t in total]

    def centred(batch) -> np.ndarray:
        return (_matrix(batch["x"], d) - base) - np.array([r / n for r in rest])

    def products(batches):
        total = np.zeros((d, d))
        for batch in batches:
            z = centred(batch)
            total += z.T @ z
        yield pd.DataFrame({"at": np.arange(d * d), "v": total.ravel()})

    cov = np.array(_summed(rows.select("x").mapInPandas(products, "at int, v double"), d * d, float)).reshape(d, d) / n
    values, axes = eigenpairs((cov + cov.T) / 2)
    trace, k = float(np.trace(cov)), min(components, d)
    some = [bool(v > 1e-13 * trace) for v in values[:k]]
    weights = np.where(some, axes[:, :k] / np.sqrt(np.where(some, values[:k], 1)), np.nan)
    model = Shared(vectors.sparkSession, weights)

    def means(batches):
        total = np.zeros(k)
        for batch in batches:
            total += (centred(batch) @ model.value).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(k), "v": total})

    mean = np.array(_summed(rows.select("x").mapInPandas(means, "at int, v double"), k, float)) / n

    def spreads(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = centred(batch) @ model.value - mean
            total += y.T @ y
        yield pd.DataFrame({"at": np.arange(k * k), "v": total.ravel()})

    spread = np.array(_summed(rows.select("x").mapInPandas(spreads, "at int, v double"), k * k, float)).reshape(k, k) / n
    off = np.abs(spread - np.eye(k))[np.ix_(some, some)]
    error = float(off.max()) if off.size else None
    shares = [float(v) / trace if trace > 0 else None for v in values[:k]]

    def deviations(x: np.ndarray) -> list[str]:
        y = x - base
        # Whole numbers of Python where 64 bits could overflow.
        wide = d * (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 >= 1 << 63
        y = y.astype(object) if wide else y
        return [str(v) for v in ((n * y - np.array(rest, y.dtype)) ** 2).sum(axis=1)]

    def project(batches):
        for batch in batches:
            y = centred(batch) @ model.value
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"],
                    "deviation": deviations(_matrix(batch["x"], d)),
                    "y": [[None if np.isnan(v) else v for v in row] for row in y.tolist()],
                }
            )

    # Ids travel as text: integers beside nulls would become floats in pandas.
    done = rows.withColumn("vec_id", F.col("vec_id").cast("string"))
    done = done.mapInPandas(project, "vec_id string, deviation string, y array<double>")
    shares_col = F.array(*[F.lit(s).cast("double") for s in shares])
    return done.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        F.col("vec_id").cast(kind).alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.get(shares_col, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
