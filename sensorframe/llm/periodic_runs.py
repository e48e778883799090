"""Periodic runs of words by internal pattern matching.

The words of many whole texts become one array of numbers, in which equal numbers mean
equal words of the same text. Prefix doubling gives the suffix array and, for each power
of two, the rank of the stretch of that length at every place. Every run holds an aligned
block of ``b`` words, ``b`` the power of two between its period and twice that, with room
for one period beside it. The occurrences of the block in the windows next to it are an
arithmetic progression; a wavelet matrix over the suffix array finds its first members
(the smallest place from a bound on within the suffixes that start with the block), and
their difference is the candidate period. Ranks then tell how far the run extends.

Work is done on some hundred thousand words at a time; a longer text is taken by itself.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words and periods at least.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Words that are worked on at once; memory for them is about 200 bytes a word.
WORDS_AT_ONCE = 200_000


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a word and one of its own after each text; the place where each text begins."""
    numbers, begins, fresh = [], [], 0
    for words in texts:
        begins.append(len(numbers))
        seen: dict[bytes, int] = {}
        for word in words:
            numbers.append(seen.setdefault(word, fresh + len(seen)))
        fresh += len(seen) + 1
        numbers.append(fresh - 1)
    return np.array(numbers, np.int64), np.array(begins, np.int64)


def _first_of_group(fresh: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def _changes(*keys: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``x``, and ranks: ``ranks[k][i]`` is where suffixes that begin like ``x[i:i + 2**k]`` begin in it.

    Only suffixes that still share their beginning with another are sorted again.
    """
    order = np.argsort(x, kind="stable")
    first = _first_of_group(_changes(x[order]))
    rank = np.empty(len(x), np.int32)
    rank[order] = first
    ranks, at = [rank], np.flatnonzero(np.bincount(first, minlength=len(x))[first] > 1)
    while len(at):
        step = 1 << (len(ranks) - 1)
        place = order[at]
        one, two = rank[place].astype(np.int64), rank[place + step].astype(np.int64)
        sort = np.argsort(one * len(x) + two, kind="stable")
        order[at] = place = place[sort]
        first = _first_of_group(_changes(one[sort], two[sort]))
        rank = rank.copy()
        rank[place] = at[first]
        ranks.append(rank)
        at = at[np.bincount(first, minlength=len(at))[first] > 1]
    return order, ranks


class WaveletMatrix:
    """Numbers 0 to n - 1 in some order; finds the smallest one from a bound on within a stretch."""

    def __init__(self, values: np.ndarray):
        self.bits = range(max(len(values).bit_length() - 1, 0), -1, -1)
        self.zeros = []
        for bit in self.bits:
            high = (values >> bit) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - high))))
            values = np.concatenate((values[high == 0], values[high == 1]))

    @staticmethod
    def _into(zeros, lo, hi, ones):
        lo0, hi0 = zeros[lo], zeros[hi]
        return np.where(ones, zeros[-1] + lo - lo0, lo0), np.where(ones, zeros[-1] + hi - hi0, hi0)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of the stretch ``lo:hi`` are less than ``bound``."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            ones = ((bound >> bit) & 1).astype(bool)
            count += np.where(ones, zeros[hi] - zeros[lo], 0)
            lo, hi = self._into(zeros, lo, hi, ones)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of the stretch ``lo:hi`` that has ``n`` smaller ones there."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            here = zeros[hi] - zeros[lo]
            ones = n >= here
            n = np.where(ones, n - here, n)
            value |= ones.astype(np.int64) << bit
            lo, hi = self._into(zeros, lo, hi, ones)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of ``lo:hi`` from ``bound`` on, or ``none``."""
        n = self.below(lo, hi, bound)
        return np.where(n < hi - lo, self.nth(lo, hi, np.minimum(n, hi - lo - 1)), none)


def _candidates(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods: the block at each place occurs again one period on."""
    n = len(order)
    if len(ranks) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Suffixes whose first two words are found nowhere else answer no query.
    repeated = np.bincount(ranks[1], minlength=n)[ranks[1][order]] > 1
    inside = np.concatenate(([0], np.cumsum(repeated)))
    kept = order[repeated]
    places = np.sort(kept)
    tree = WaveletMatrix(np.searchsorted(places, kept))
    ends = np.append(places, n)

    def successor(lo, hi, bound):
        return ends[tree.successor(lo, hi, np.searchsorted(places, bound), len(places))]

    starts, periods = [], []
    for k in range(1, len(ranks)):
        b = 1 << k
        size = np.bincount(ranks[k], minlength=n)
        block = np.arange(0, n, b)
        block = block[size[ranks[k][block]] > 1]
        if not len(block):
            continue
        lo, hi = inside[ranks[k][block]], inside[ranks[k][block] + size[ranks[k][block]]]
        after = successor(lo, hi, block + 1)
        one = successor(lo, hi, np.maximum(block - b, 0))
        two = successor(lo, hi, one + 1)
        for start, period, found in ((block, after - block, after < n), (one, two - one, one < block)):
            # Periods below b / 2 are those of shorter blocks.
            found &= (period <= b) & (2 * period >= b)
            starts.append(start[found])
            periods.append(period[found])
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def find_runs(x: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs in ``x``, by start, then period."""
    order, ranks = suffix_order(x)
    start, period = _candidates(order, ranks)
    left, right = start.copy(), start.copy()
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        same = ranks[k][right] == ranks[k][right + period]
        right += np.where(same, step, 0)
        back = np.maximum(left - step, 0)
        same = (left >= step) & (ranks[k][back] == ranks[k][back + period])
        left = np.where(same, back, left)
    length = right + period - left
    keep = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    return np.unique(np.stack([left, length, period], axis=1)[keep][:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def runs_of_texts(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """For each text its runs and the words outside repeated periods."""
    x, begins = number_words(texts)
    runs = find_runs(x)
    ends = np.append(begins, len(x))
    marks = np.zeros(len(x) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(marks) == 0
    cuts = np.searchsorted(runs[:, 0], ends)
    found, kept = [], []
    for words, (begin, end), (first, last) in zip(texts, pairwise(ends.tolist()), pairwise(cuts.tolist())):
        found.append(runs[first:last] - [begin, 0, 0])
        kept.append(words if first == last else [w for w, s in zip(words, stays[begin : end - 1].tolist()) if s])
    return found, kept


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)``, one row per input row.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch
    whose words repeat with their smallest period, of at least six words and four
    periods, that no neighbouring word extends; runs are sorted by start, then period,
    and may overlap. ``collapsed`` is the text without words that a run holds after its
    first period, joined by one space. Null and empty texts, or texts of white space,
    have no words, no runs and an empty ``collapsed``. Rows are worked on one by one:
    repeated rows and null ids give a row each, an empty table none. Other columns of
    ``docs`` are not read. Texts of any length are taken whole.
    """

    def flush(ids, texts):
        found, kept = runs_of_texts(texts)
        sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found)
        entries = pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], fields=list(RUNS.value_type))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(sizes), entries),
                pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches):
        ids, texts, n = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0).slice(i, 1))
                texts.append((batch.column(1)[i].as_py() or "").encode().split())
                n += len(texts[-1]) + 1
                if n >= WORDS_AT_ONCE:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
        if texts:
            yield flush(ids, texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {run_type}, collapsed string")
