"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pre-tokens of a block of documents, lays their bytes
out in one array, and indexes every pair that has a merge rank by all the places
where it occurs. The active ranks are applied in ascending order, each to all of
its places at once; the pairs a merge creates enter the lists of their own ranks.
Documents are then read off the encoded pre-tokens.

The vocabulary file is read on the driver and sent to the tasks: its size is that
of one public tokenizer, whatever the size of the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import Shared

#: The public pattern that byte-level BPE vocabularies split text with.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 16_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Numbering(dict):
    """Numbers new keys in the order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Vocabulary:
    """Merges, byte strings and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            known = all(c in alphabet for c in token)
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = ids[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none (ends of words are negative ids)."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.rank_of_key[at], -1)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the bounds of each piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    # One separator (-1) before every piece and one after the last.
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.full(starts[-1] + 1, -1, np.int32)
    inside = np.ones(len(symbols), bool)
    inside[starts] = False
    symbols[inside] = vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.arange(1, len(symbols) + 1, dtype=np.int32)
    before = np.arange(-1, len(symbols) - 1, dtype=np.int32)

    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(at: np.ndarray, rank: np.ndarray) -> None:
        found = rank >= 0
        at, rank = at[found], rank[found]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for one, where in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if one not in places:
                places[one] = []
                heapq.heappush(active, one)
            places[one].append(where)

    every = np.arange(len(symbols) - 1, dtype=np.int32)
    index(every, vocab.ranks(symbols[:-1], symbols[1:]))
    while active:
        rank = heapq.heappop(active)
        lists = places.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        left, right, made = vocab.left[rank], vocab.right[rank], vocab.made[rank]
        at = at[symbols[at] == left]
        at = at[symbols[after[at]] == right]
        if left == right:
            at = _leftmost(np.unique(at), after)
        elif len(lists) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        symbols[at] = made
        symbols[gone] = -2
        after[at] = follow
        before[follow] = at
        previous = before[at]
        index(
            np.concatenate([previous, at]),
            vocab.ranks(
                np.concatenate([symbols[previous], symbols[at]]),
                np.concatenate([symbols[at], symbols[follow]]),
            ),
        )
    kept = np.flatnonzero(symbols >= 0)
    return symbols[kept], np.searchsorted(kept, starts)


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping places of a pair of two equal symbols, every other one from the left."""
    if len(at) < 2:
        return at
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    heads = np.flatnonzero(~chained)
    position = np.arange(len(at)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(at)]])))
    return at[position % 2 == 0]


def ragged(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``values[bounds[p]:bounds[p + 1]]`` of all picks in a row, and their sizes."""
    sizes = np.diff(bounds)[picks]
    total = int(sizes.sum())
    if not total:
        return values[:0], sizes
    ends = np.cumsum(sizes)
    shift = np.repeat(bounds[picks] - (ends - sizes), sizes)
    return values[np.arange(total) + shift], sizes


def encode_stretches(stretches: list, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches one after another, and the bounds of each; ``("special", s)`` is a special string."""
    split = regex.compile(SPLIT_PATTERN)
    words = Numbering()
    special: dict[int, int] = {}
    parts: list[list[int]] = []  # numbers of the pre-tokens of each stretch
    for stretch in stretches:
        if isinstance(stretch, tuple):
            special[words[stretch]] = vocab.special[stretch[1]]
            parts.append([words[stretch]])
        elif (stretch[1:] if stretch[:1] == " " else stretch).isalpha() and stretch.isascii():
            parts.append([words[stretch]])
        else:
            parts.append([words[w] for w in split.findall(stretch)])
    pieces = [b"" if isinstance(w, tuple) else w.encode("utf-8", "surrogatepass") for w in words]
    ids, bounds = encode_pieces(pieces, vocab)
    if special:
        ids, bounds = _with_special(ids, bounds, special)
    flat = np.fromiter((w for part in parts for w in part), np.int64)
    out, sizes = ragged(ids, bounds, flat)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return out, ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds of each text.

    Text between single spaces splits the same way wherever it stands, so each
    distinct stretch is split once; texts with runs of white space are split whole.
    """
    runs = regex.compile(r"\s\s")
    names = sorted(vocab.special, key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, names))) if names else None
    number = Numbering()

    def stretch_numbers(part: str) -> list[int]:
        if runs.search(part):
            return [number[part]]
        first, *rest = part.split(" ")
        return ([number[first]] if first else []) + [number[" " + s] for s in rest]

    picks, counts = [], []
    for text in texts:
        if special is not None and special.search(text):
            mine, at = [], 0
            for hit in special.finditer(text):
                mine += stretch_numbers(text[at : hit.start()])
                mine.append(number[("special", hit.group())])
                at = hit.end()
            mine += stretch_numbers(text[at:])
        else:
            mine = stretch_numbers(text)
        picks.append(np.array(mine, np.int64))
        counts.append(len(mine))
    stretch_ids, stretch_bounds = encode_stretches(list(number), vocab)
    chosen = np.concatenate(picks) if picks else np.zeros(0, np.int64)
    out, sizes = ragged(stretch_ids, stretch_bounds, chosen)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return out, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def _with_special(ids: np.ndarray, bounds: np.ndarray, special: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of special strings in the place of their empty pieces."""
    words = np.array(sorted(special), np.int64)
    ids = np.insert(ids, bounds[words], [special[w] for w in words.tolist()])
    added = np.zeros(len(bounds), np.int64)
    added[words + 1] = 1
    return ids, bounds + np.cumsum(added)


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
    table = vocab.bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_blocks(texts: Iterable[str | None], vocab: Vocabulary) -> Iterator[list[np.ndarray]]:
    """The ids of each text, worked out in blocks of bounded text (one text at least)."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield _ids_of(block, vocab)
            block, size = [], 0
    if block:
        yield _ids_of(block, vocab)


def _ids_of(block: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    ids, bounds = encode_texts(block, vocab)
    return np.split(ids, bounds[1:-1])


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids array<int>``: the ids of the whole text.

    A null text counts as empty and has no ids. Rows are independent of each
    other, so nothing is shuffled. A column named like ``ids_col`` is replaced.
    """
    shared = Shared(docs.sparkSession, Vocabulary(tokenizer_path))
    docs = docs.drop(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            done = 0
            for lists in encode_blocks((t.as_py() for t in batch.column(text_col)), shared.value):
                part = batch.slice(done, len(lists))
                done += len(lists)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    return docs.mapInArrow(run, f"{schema}, `{ids_col}` array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that ``ids_col`` stands for; null ids give an empty text."""
    shared = Shared(encoded.sparkSession, Vocabulary(tokenizer_path))

    @F.pandas_udf("string")
    def read(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: "" if x is None else decode_ids(np.asarray(x), shared.value))

    return encoded.withColumn(text_col, read(ids_col))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text of every row.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``. Ids are digested as
    little-endian unsigned 32-bit integers, text in UTF-8. One row per input row;
    null ids of rows stay null, a null text is empty.
    """
    shared = Shared(docs.sparkSession, Vocabulary(tokenizer_path))

    def run(batches):
        vocab = shared.value
        for batch in batches:
            ids = [x.astype("<u4") for lists in encode_blocks(batch["text"].tolist(), vocab) for x in lists]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(decode_ids(x, vocab).encode()).hexdigest() for x in ids],
                }
            )

    # Ids travel as text: integers beside nulls would become floats in pandas.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    digests = rows.mapInPandas(run, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return digests.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
