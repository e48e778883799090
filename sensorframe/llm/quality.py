"""Text quality by regularised quadratic discriminant analysis.

Every document becomes a short vector of transformed statistics of its text. The
two classes are Gaussians in that space, each with its own covariance, shrunk
towards its diagonal. The score is the logistic of the difference of the two log
densities (Mahalanobis distances through the Cholesky factors) and of the priors.

Class moments are sums over all labelled training rows, added up by Spark; only
they reach the driver, and their size is that of the vector squared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import Shared, stored

SHRINKAGE = 0.02
RIDGE = 1e-3
ACCEPT = 0.7
#: Rows of a batch that are worked on and returned at once.
PIECE_ROWS = 500
ZLIB_PIECE = 1 << 16

FEATURES = (
    "word_length",
    "words_per_line",
    "letters",
    "upper",
    "digits",
    "stops",
    "marks",
    "bars",
    "shouts",
    "marked_words",
    "distinct_words",
    "top_word",
    "repeated_next",
    "distinct_lines",
    "compressed",
)
#: Shares are those of the text and this much neutral text, so a few characters decide nothing in a short one.
NEUTRAL_BYTES = 200
NEUTRAL_WORDS = 30
NEUTRAL_LINES = 2


def _bytes_in(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _UPPER | _bytes_in("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_DIGITS, _STOPS, _SHOUTS, _BARS = _bytes_in("0123456789"), _bytes_in(".,;:?"), _bytes_in("!"), _bytes_in("|")
_MARKS = _bytes_in("#$%&*@~^_=+<>{}[]\\/`")


def _log_share(count: float, size: float, neutral: float) -> float:
    return float(np.log((count + 0.002 * neutral) / (size + neutral) + 0.002))


def _share(count: float, size: float, neutral: float, usual: float) -> float:
    return float((count + usual * neutral) / (size + neutral))


def statistics(text: str) -> list[float]:
    """The vector of one text, in the order of ``FEATURES``; of an empty text too."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n, size = len(words), len(raw)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    letters = int(counts[_LETTERS].sum())
    pieces = [raw[i : i + ZLIB_PIECE] for i in range(0, size, ZLIB_PIECE)]
    packed = sum(len(zlib.compress(p, 1)) for p in pieces)
    marked = sum(1 for w in words if _MARKS[w[-1]] or w[-1] == 33)
    repeated = sum(1 for a, b in zip(words, words[1:]) if a == b)
    top = max(seen.values(), default=0)
    return [
        float(np.log(_share(sum(map(len, words)), n, NEUTRAL_WORDS, 5.0))),
        float(np.log(_share(n, len(lines), NEUTRAL_LINES, 20.0))),
        _share(letters, size, NEUTRAL_BYTES, 0.8),
        _log_share(int(counts[_UPPER].sum()), letters, NEUTRAL_BYTES),
        _log_share(int(counts[_DIGITS].sum()), size, NEUTRAL_BYTES),
        _log_share(int(counts[_STOPS].sum()), size, NEUTRAL_BYTES),
        _log_share(int(counts[_MARKS].sum()), size, NEUTRAL_BYTES),
        _log_share(int(counts[_BARS].sum()), size, NEUTRAL_BYTES),
        _log_share(int(counts[_SHOUTS].sum()), size, NEUTRAL_BYTES),
        _log_share(marked, n, NEUTRAL_WORDS),
        float(np.log(len(seen) + NEUTRAL_WORDS) / np.log(n + NEUTRAL_WORDS)),
        _log_share(top, n, NEUTRAL_WORDS),
        _log_share(repeated, n, NEUTRAL_WORDS),
        _share(len(set(lines)), len(lines), NEUTRAL_LINES, 1.0),
        float(np.log(_share(packed, size, NEUTRAL_BYTES, 0.5))),
    ]


def _by_piece(batches, work):
    """``work`` on pieces of ``PIECE_ROWS`` rows; what the texts took goes back to the machine, as idle workers keep it otherwise."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE_ROWS):
            yield work(batch.slice(i, PIECE_ROWS))
        del batch
    pa.default_memory_pool().release_unused()


def features(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id string, held_out, x array<double>)``, one row per input row; a null text is empty."""

    def run(batches):
        def one(batch):
            # One text at a time: those of a whole batch are never Python strings together.
            x = pa.array([statistics(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), x], ["doc_id", "held_out", "x"])

        yield from _by_piece(batches, one)

    # Ids travel as text: integers beside nulls would become floats in pandas.
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, "doc_id string, held_out boolean, x array<double>")


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of ``x`` for each ``label``, over all rows."""
    d = len(FEATURES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.array(batch["x"].tolist(), float).reshape(-1, d), batch["label"].to_numpy()
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for k in (0, 1):
            yield pd.DataFrame({"label": k, "at": np.arange(sums.shape[1]), "v": sums[k]})

    # An exchange ends the stage that makes the vectors: two Python functions in one stage keep two workers a core.
    parts = labelled.repartition(F.xxhash64("x")).mapInPandas(run, "label int, at int, v double")
    total = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        total[row["label"], row["at"]] = row["v"]
    return {k: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for k, t in enumerate(total)}


class Discriminant:
    """Two Gaussians with shrunk covariances, held as means and Cholesky factors."""

    def __init__(self, found: dict[int, tuple], shrinkage: float = SHRINKAGE, ridge: float = RIDGE):
        n = np.array([found[k][0] for k in (0, 1)])
        self.prior = (n + 1) / (n.sum() + 2)
        #: With a class that has no row there is nothing to tell apart.
        self.usable = bool((n >= 2).all())
        self.parts = []
        for k in (0, 1) if self.usable else ():
            count, first, second = found[k]
            mean = first / count
            cov = second / count - np.outer(mean, mean)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, factor, np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not self.usable:
            return np.full(len(x), self.prior[1])
        logs = []
        for (mean, factor, half_log_det), prior in zip(self.parts, self.prior):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(np.log(prior) - half_log_det - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(x, label)`` of the rows of ``features`` that are not held out and have a label."""
    known = labels.filter(F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).cast("string").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return rows.filter(~F.col("held_out")).join(known, "doc_id").select("x", "label")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    accept: float = ACCEPT,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    ``score`` is the probability that the label is 1, ``predicted`` is 1 from
    ``accept`` on. Labels are learned from rows where ``held_out`` is false; the
    score depends on the text alone. Null texts are empty texts, which are scored like
    any other; null ids are never labelled; null labels and labels other than 0
    and 1 are passed over; repeated label rows count each. If a class has fewer than
    two training rows, all scores are the share of class 1. An empty table gives no rows.
    """
    rows = stored(features(docs, held_out, id_col, text_col))
    found = Discriminant(moments(_labelled(rows, labels, id_col, label_col)))
    model = Shared(docs.sparkSession, found)

    def run(batches):
        for batch in batches:
            score = model.value.score(np.array(batch["x"].tolist(), float).reshape(-1, len(FEATURES)))
            predicted = (score >= accept).astype(np.int32)
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=predicted)

    scored = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    accept: float = ACCEPT,
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts 1, columns as they are; texts are never shuffled."""
    # Rows that are held out teach nothing, so their statistics are worked out once, when they are scored.
    rows = features(docs.filter(~held_out), held_out, id_col, text_col)
    found = Discriminant(moments(_labelled(rows, labels, id_col, label_col)))
    model = Shared(docs.sparkSession, found)

    def run(batches):
        def one(batch):
            x = [statistics(t.as_py() or "") for t in batch.column(text_col)]
            score = model.value.score(np.array(x, float).reshape(-1, len(FEATURES)))
            return batch.filter(pa.array(score >= accept))

        yield from _by_piece(batches, one)

    return docs.mapInArrow(run, docs.schema)
