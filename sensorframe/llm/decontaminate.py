"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words: positions marked 1 are hashed, the others
are ignored, so a changed word there does not hide a hit. The masks below are such
that every aligned stretch of 12 to 23 words, a fifth of them or fewer substituted,
has a hit (checked over all patterns in the tests). Hits only propose an alignment: around
each one the words are compared, and a leak is an aligned stretch of ``MIN_WORDS``
words or more of which ``SIMILARITY`` are equal. Of a stretch of 24 words or more one
half is no worse than the whole, so none is missed. Items with fewer words must occur
whole and unchanged.

The seeds of the benchmark reach the tasks as a bit table of fixed size. Words
around the positions that pass it, and nothing else of a document, are written to
a table; the exact join with the seeds, and the comparison, run on that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import Shared, free_name, stored

MASKS = ("111111", "1010001111", "1101011001", "110010111", "1110011")
MIN_WORDS = 12
SIMILARITY = 0.8
#: Bits of the table that documents are looked up in; its size does not depend on the benchmark.
TABLE_BITS = 24


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


#: Weights of the places of a seed; a mask marks at most as many.
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INSIDE = np.ones(256, np.int8)
_INSIDE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are hashed at once, unless one text is longer.
BLOCK_BYTES = 1 << 18


def _factors(n: int) -> np.ndarray:
    """The weights of ``n`` marked places: the fixed ones, then as many more as a long item needs."""
    if n <= len(_FACTORS):
        return _FACTORS[:n]
    more = np.random.default_rng(6).integers(1, 1 << 63, n - len(_FACTORS), dtype=np.uint64)
    return np.concatenate([_FACTORS, more * np.uint64(2) + np.uint64(1)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(29))


class WordHashes:
    """Places and hashes of all words of lower-case bytes, from running sums of weighted bytes.

    Byte ``k`` weighs ``base ** k``; the sum over a word, divided by the power of its
    start (the base is odd, so it has an inverse), does not depend on where it stands.
    """

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            first = np.ones(1, np.uint64)
            self._up = np.concatenate([first, np.cumprod(np.full(n, _BASE, np.uint64))])
            self._down = np.concatenate([first, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        self._powers(len(raw))
        edges = np.diff(_INSIDE[raw], prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * self._up[: len(raw)], out=sums[1:])
        return starts, ends, _mixed((sums[ends] - sums[starts]) * self._down[starts])


def products_of(words: np.ndarray, n: int) -> list[np.ndarray]:
    """Word hashes times each of the first ``n`` weights; all masks add up the same products."""
    return [words * factor for factor in _factors(n)]


def seed_hashes(products: list[np.ndarray], mask: str) -> np.ndarray:
    """Hash of the marked positions at every place of a row of words."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = max(len(products[0]) - len(mask) + 1, 0)
    total = np.full(n, (len(mask) * 1_000_003 + int(mask, 2)) & ((1 << 64) - 1), np.uint64)
    for product, i in zip(products, at):
        total += product[i : i + n]
    return _mixed(total)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the bit table for each hash."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(TABLE_BITS)) & mask).astype(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts as lower-case bytes, in blocks of bounded size, each with the number of its first text."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode().lower()
        if block and size + len(data) > BLOCK_BYTES:
            yield first, block
            first, block, size = i, [], 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield first, block


def longest_stretch(equal: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bounds of the longest run of places of which ``similarity`` are true."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    # Sums from the left that are lower than all before, and for each end the first of them that allows it.
    lows = np.flatnonzero(gain <= np.minimum.accumulate(gain) + 1e-9)
    levels = np.minimum.accumulate(gain)[lows]
    first = np.searchsorted(-levels, -(gain + 1e-9), side="left")
    ends = np.flatnonzero(first < len(lows))
    starts = lows[first[ends]]
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, words)`` of the items that have words."""

    def split(batches):
        for batch in batches:
            words = [[w.decode() for w in words_of(t or "")] for t in batch["text"]]
            yield batch.drop(columns="text").assign(words=words)

    rows = benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")
    )
    return rows.mapInPandas(split, "item bigint, item_id string, words array<string>").filter("size(words) > 0")


def _seeds(items: DataFrame, masks: tuple[str, ...], min_words: int) -> DataFrame:
    """``(hash, item, item_pos)``; short items are one seed as a whole."""

    def run(batches):
        hashes_of = WordHashes()
        for batch in batches:
            out = []
            for item, words in zip(batch["item"], batch["words"]):
                hashes = hashes_of(" ".join(words).encode())[2]
                chosen = masks if len(hashes) >= min_words else ("1" * len(hashes),)
                products = products_of(hashes, max(m.count("1") for m in chosen))
                for mask in chosen:
                    found = seed_hashes(products, mask)
                    out.append(pd.DataFrame({"hash": found.astype(np.int64), "item": item, "item_pos": np.arange(len(found))}))
            if out:
                yield pd.concat(out)

    return items.select("item", "words").mapInPandas(run, "hash bigint, item bigint, item_pos bigint")


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """The places of all seeds as packed bits, gathered in words of 32 bits."""

    def places(batches):
        for batch in batches:
            yield pd.DataFrame({"bit": np.concatenate(_bits(batch["hash"].to_numpy().astype(np.uint64)))})

    bits = seeds.select("hash").mapInPandas(places, "bit bigint")
    word = bits.groupBy(F.shiftright("bit", 5).alias("word"))
    table = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    for row in word.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toLocalIterator():
        table[row["word"]] = row["bits"]
    return table


def _passages(docs: DataFrame, table, masks: tuple[str, ...], longest: int) -> DataFrame:
    """Stretches of documents around places that pass the bit table, with the hashes found there."""

    def run(batches):
        seen = np.unpackbits(table.value.view(np.uint8), bitorder="little").view(bool)
        hashes_of = WordHashes()
        lengths = np.array([len(m) for m in masks])
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "doc", "start", "words", "hash", "pos")}
            ids, docs_here = batch["doc_id"].tolist(), batch["doc"].tolist()
            for first_text, block in _blocks(batch["text"].tolist()):
                data = b" ".join(block)
                starts, ends, hashes = hashes_of(data)
                products = products_of(hashes, max(m.count("1") for m in masks))
                at, found, number = [], [], []
                for k, mask in enumerate(masks):
                    seeds = seed_hashes(products, mask)
                    hit = np.flatnonzero(seen[_bits(seeds)[0]])
                    hit = hit[seen[_bits(seeds[hit])[1]]]
                    at.append(hit)
                    found.append(seeds[hit])
                    number.append(np.full(len(hit), k))
                at, found, number = np.concatenate(at), np.concatenate(found), np.concatenate(number)
                if not len(at):
                    continue
                # Words of text t of the block are those from bounds[t] on; a seed must not cross into the next text.
                offsets = np.cumsum([0, *(len(t) + 1 for t in block)])
                bounds = np.searchsorted(starts, offsets)
                owner = np.searchsorted(bounds, at, side="right") - 1
                inside = at + lengths[number] <= bounds[owner + 1]
                at, found, owner = at[inside], found[inside], owner[inside]
                order = np.argsort(at, kind="stable")
                at, found, owner = at[order], found[order], owner[order]
                apart = (np.diff(at) > 2 * longest) | (np.diff(owner) > 0)
                for part in np.split(np.arange(len(at)), np.flatnonzero(apart) + 1) if len(at) else ():
                    text = int(owner[part[0]])
                    low, high = int(bounds[text]), int(bounds[text + 1])
                    first = max(int(at[part[0]]) - longest, low)
                    last = min(int(at[part[-1]]) + 2 * longest, high)
                    out["doc_id"].append(ids[first_text + text])
                    out["doc"].append(docs_here[first_text + text])
                    out["start"].append(first - low)
                    out["words"].append([w.decode() for w in data[starts[first] : ends[last - 1]].split()])
                    out["hash"].append(found[part].astype(np.int64))
                    out["pos"].append(at[part] - low)
            if out["doc"]:
                yield pd.DataFrame(out)

    return docs.mapInPandas(
        run, "doc_id string, doc bigint, start bigint, words array<string>, hash array<bigint>, pos array<bigint>"
    )


def _compare(batches, min_words: int, similarity: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for words, item, start, shift in zip(batch["words"], batch["item_words"], batch["start"], batch["shift"]):
            # Word i of the item lies at word i + shift of the document.
            first = max(0, start - shift)
            last = min(len(item), start + len(words) - shift)
            here = words[first + shift - start : last + shift - start]
            equal = np.asarray(here, object) == np.asarray(item[first:last], object)
            a, b = longest_stretch(equal, similarity)
            short = len(item) < min_words
            ok = (b - a == len(item) and equal.all()) if short else b - a >= min_words
            out.append((b - a if ok else 0, int(equal[a:b].sum()), first + a + shift, first + a))
        found = pd.DataFrame(out, columns=["n_words", "n_equal", "doc_start", "item_start"])
        frame = pd.concat([batch[["doc_id", "doc", "item", "item_id"]].reset_index(drop=True), found], axis=1)
        yield frame[frame["n_words"] > 0]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Leaked items: ``(doc_id, doc, item_id, n_words, n_equal, doc_start, item_start)``.

    One row for each document and benchmark item that share an aligned stretch of
    ``min_words`` words or more of which ``similarity`` are equal: the longest one,
    the first of several. Starts count words from 0. ``doc`` is a hash of id and text
    that names the row where ids are null or repeat; repeated rows count once. Null
    texts are empty and leak nothing, nor do items without words. An empty
    table on either side gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias("doc"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    items = stored(_items(benchmark, item_id_col, item_text_col))
    seeds = stored(_seeds(items, masks, min_words))
    sizes = items.groupBy(F.size("words").alias("n")).count()
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    short = tuple("1" * row["n"] for row in sizes.filter(F.col("n") < min_words).collect())
    table = Shared(docs.sparkSession, _bit_table(seeds))
    passages = stored(
        _passages(rows, table, (*masks, *(m for m in short if m not in masks)), longest).withColumn(
            "passage", F.xxhash64("doc", "start")
        )
    )
    hits = passages.select("passage", F.explode(F.arrays_zip("hash", "pos")).alias("hit"))
    hits = hits.select("passage", "hit.hash", "hit.pos").join(seeds, "hash")
    aligned = hits.select("passage", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    whole = passages.select("passage", "doc_id", "doc", "start", "words").dropDuplicates(["passage"])
    texts = items.withColumnRenamed("words", "item_words")
    both = aligned.join(whole, "passage").join(texts, "item")
    found = both.mapInPandas(
        lambda batches: _compare(batches, min_words, similarity),
        "doc_id string, doc bigint, item bigint, item_id string, n_words bigint, n_equal bigint, doc_start bigint, item_start bigint",
    )
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("doc"), (-F.col("item_start")).alias("item")))
    best = found.groupBy("doc_id", "doc", "item", "item_id").agg(best.alias("best"))
    return best.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "doc",
        F.col("item_id").cast(benchmark.schema[item_id_col].dataType).alias("item_id"),
        "best.n_words",
        "best.n_equal",
        (-F.col("best.doc")).alias("doc_start"),
        (-F.col("best.item")).alias("item_start"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that leak an item; columns stay as they are."""
    found = stored(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc").distinct())
    name = free_name(docs.columns)
    marked = docs.withColumn(name, F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))))
    return marked.join(found.withColumnRenamed("doc", name), name, "left_anti").select(docs.columns)
