"""Scores of whole texts under a causal attention model trained on the corpus.

1. Documents are dealt into chunks of bounded text by a hash. Every chunk gives its
   distinct words with their training counts; one window per word adds the counts
   up, so each chunk gets back the totals of exactly its own words. No word table
   is collected or broadcast.
2. The distinct words are written as public subword ids. The most frequent ids and
   all bytes form the vocabulary of the model; rarer ids are split back into the
   two parts they were merged from. The number of ids is that of the vocabulary file.
   Every chunk then writes its texts as ids, once for training and scoring.
3. The model is trained by rounds of local steps: all documents that are not held out
   are dealt into shards, every shard trains on its windows, a part of them in each
   round and all of them once, and the parameters are averaged over the shards in a tree.
4. The ids of all texts are scored with the final parameters. The score of a
   text is the probability of its ids, up to and with the end of the text, under the
   attention model alone. The counts give the base score, which has no part in it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm import attention as A
from sensorframe.llm.bpe import Numbering, Vocabulary, encode_stretches, ragged
from sensorframe.llm.tables import Shared, stored

CHUNK_CHARS = 8_000_000
#: Characters of texts that are written as ids at once.
ENCODED_CHARS = 4_000_000
SHARD_TOKENS = 1_000_000
#: Ids that are scored at once; a longer text is by itself.
SCORED_IDS = 4_000_000
ROUNDS = 4
WORDS_AT_ONCE = 200_000
AVERAGED_AT_ONCE = 16


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def _number(texts) -> tuple[dict[bytes, int], list[np.ndarray]]:
    number = Numbering()
    rows = []
    for text in texts:
        words = words_of(text)
        rows.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return number, rows


def chunked(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> tuple[DataFrame, int]:
    """``(doc_id, text, held_out, chunk)``, and the number of training documents.

    Ids travel as text: integers beside nulls would become floats in pandas.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        held_out.alias("held_out"),
    )
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum((~F.col("held_out")).cast("bigint")).alias("train"))
    facts = facts.first()
    chunks = max(1, math.ceil((facts["chars"] or 0) / CHUNK_CHARS))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), facts["train"] or 0


def word_counts(rows: DataFrame) -> DataFrame:
    """``(chunk, word, c, first)``: every word of every chunk with its count in all training texts.

    ``first`` marks one row of each word.
    """

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        number, words = _number(frame["text"])
        taught = [mine for mine, held in zip(words, frame["held_out"]) if not held]
        n = np.bincount(np.concatenate(taught), minlength=len(number)) if taught else np.zeros(len(number), np.int64)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[0], "word": list(number), "n": n})

    pairs = rows.groupBy("chunk").applyInPandas(count, "chunk bigint, word binary, n bigint")
    same = Window.partitionBy("word")
    return pairs.select(
        "chunk",
        "word",
        F.sum("n").over(same).alias("c"),
        (F.min("chunk").over(same) == F.col("chunk")).alias("first"),
    )


def _word_ids(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return encode_stretches([" " + w.decode() for w in words], vocab)


def model_vocabulary(words: DataFrame, vocab, end_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How each public id is written in ids of the model, and the training counts of those.

    Returns values and bounds of the ragged table, and counts by model id. Collects
    one count for each id of the vocabulary file.
    """

    def count(batches):
        words, totals = [], []

        def counted():
            ids, bounds = _word_ids(words, vocab.value)
            n = np.bincount(ids, np.repeat(np.array(totals, float), np.diff(bounds)))
            at = np.flatnonzero(n)
            return pd.DataFrame({"id": at, "n": n[at].astype(np.int64)})

        for batch in batches:
            words += batch["word"].tolist()
            totals += batch["c"].tolist()
            # Many words at once, as every rank of the merges is met once for all of them.
            if len(words) >= WORDS_AT_ONCE:
                yield counted()
                words, totals = [], []
        if words:
            yield counted()

    counted = words.filter("first and c > 0").select("word", "c").mapInPandas(count, "id bigint, n bigint")
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()
    size = len(vocab.value.bytes_of)
    counts = np.zeros(size, np.int64)
    for row in found:
        counts[row["id"]] = row["n"]
    base = set(vocab.value.byte_ids.tolist())
    frequent = [i for i in np.lexsort((np.arange(size), -counts)).tolist() if i not in base]
    kept = frequent[: A.VOCABULARY - 1 - len(base)] + sorted(base)
    kept.sort(key=lambda i: (-counts[i], i))
    spelled: list[list[int] | None] = [None] * size
    for new, old in enumerate(kept):
        spelled[old] = [new]
    parts = {int(m): (int(a), int(b)) for a, b, m in zip(vocab.value.left, vocab.value.right, vocab.value.made)}

    def spell(i: int) -> list[int]:
        if spelled[i] is None:
            spelled[i] = spell(parts[i][0]) + spell(parts[i][1]) if i in parts else []
        return spelled[i]

    table = [spell(i) for i in range(size)]
    sizes = np.fromiter(map(len, table), np.int64, size)
    values = np.fromiter((x for one in table for x in one), np.int64)
    new_counts = np.bincount(values, np.repeat(counts, sizes), A.VOCABULARY)
    new_counts[A.END] = end_count
    return values, np.concatenate([[0], np.cumsum(sizes)]), new_counts


def _document_ids(texts, vocab: Vocabulary, spelling) -> tuple[dict, list, np.ndarray, np.ndarray]:
    """Distinct words, words of each text, and the model ids of all texts with their bounds."""
    number, rows = _number(texts)
    ids, bounds = _word_ids(list(number), vocab)
    values, sizes = ragged(*spelling, ids)
    word_bounds = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    out, sizes = ragged(values, word_bounds, every)
    last = np.cumsum([len(x) for x in rows], dtype=np.int64)
    ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[last]])
    return number, rows, np.insert(out, ends[1:], A.END), ends + np.arange(len(ends))


def training_shards(rows: DataFrame, vocab, spelling, shards: int) -> DataFrame:
    """``(shard, n, ids)``: the ids of all documents that are not held out, one row for each shard.

    ``rows`` hold texts, or those of ``written`` ids.
    """

    def encode(batches):
        for batch in batches:
            keys, texts = batch["key"].to_numpy(), batch["text"].tolist()
            part = np.cumsum([len(t) for t in texts]) // ENCODED_CHARS
            for mine in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                _, _, ids, bounds = _document_ids([texts[i] for i in mine], vocab.value, spelling.value)
                lists = np.split(ids.astype("<i2"), bounds[1:-1])
                yield pd.DataFrame({"key": keys[mine], "ids": [x.tobytes() for x in lists]})

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "ids"], kind="stable")
        n = np.array([len(x) // 2 for x in frame["ids"]], "<i8")
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "n": [n.tobytes()], "ids": [b"".join(frame["ids"])]})

    taught = rows.filter(~F.col("held_out"))
    if "ids" in rows.columns:
        taught = taught.select("key", "ids")
    else:
        taught = taught.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInPandas(encode, "key bigint, ids binary")
    taught = taught.withColumn("shard", F.pmod("key", F.lit(shards)))
    # A number of its own keeps the shards apart, small as they are in bytes.
    dealt = taught.repartition(shards, "shard").groupBy("shard")
    return dealt.applyInPandas(together, "shard bigint, n binary, ids binary")


def written(rows: DataFrame, words: DataFrame, vocab, spelling, train_docs: int, log_all: float) -> DataFrame:
    """Every text as ids of the model, with a key of its row and its base score.

    ``(doc_id, held_out, key, n_tokens, n_known, base_score, ids)``; the words of a chunk are those of ``word_counts``.
    """

    def one(docs_of: pd.DataFrame, words_of_chunk: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip(words_of_chunk["word"], words_of_chunk["c"]))
        number, picks, ids, at = _document_ids(docs_of["text"], vocab.value, spelling.value)
        c = np.fromiter((total[w] for w in number), np.int64, len(number))
        # One more word: the end of a text.
        c = np.append(c, train_docs)
        base, known = np.log10(c + 1.0) - log_all, c > 0
        tokens = np.concatenate([np.append(x, len(number)) for x in picks])
        n = np.array([len(x) + 1 for x in picks])
        first = np.cumsum(n) - n
        return pd.DataFrame(
            {
                "doc_id": docs_of["doc_id"],
                "held_out": docs_of["held_out"],
                "key": docs_of["key"],
                "n_tokens": n,
                "n_known": np.add.reduceat(known[tokens].astype(np.int64), first),
                "base_score": np.add.reduceat(base[tokens], first),
                "ids": [x.tobytes() for x in np.split(ids.astype("<i2"), at[1:-1])],
            }
        )

    schema = "doc_id string, held_out boolean, key bigint, n_tokens bigint, n_known bigint, base_score double, ids binary"
    own = words.select("chunk", "word", "c").groupBy("chunk")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    return keyed.groupBy("chunk").cogroup(own).applyInPandas(one, schema)


def train_model(rows: DataFrame, vocab, spelling, counts: np.ndarray) -> dict:
    """Parameters of the model, trained on all documents that are not held out; ``counts`` are those of their ids."""
    spark = rows.sparkSession
    params = A.initial(counts)
    tokens = int(counts.sum())
    if not tokens:
        return params
    shards = math.ceil(tokens / SHARD_TOKENS)
    samples = stored(training_shards(rows, vocab, spelling, shards))
    shape = {k: v for k, v in params.items()}

    def mean(numbers, weights, packed) -> pd.DataFrame:
        total = sum(w * np.frombuffer(x, np.float32).astype(float) for w, x in zip(weights, packed))
        one = (total / sum(weights)).astype(np.float32).tobytes()
        return pd.DataFrame({"shard": [min(numbers)], "weight": [float(sum(weights))], "params": [one]})

    for number in range(ROUNDS):
        now = Shared(spark, params)

        def steps(batches):
            numbers, weights, packed = [], [], []
            for batch in batches:
                for shard, n, ids in zip(batch["shard"], batch["n"], batch["ids"]):
                    ids = np.frombuffer(ids, "<i2").astype(np.int64)
                    bounds = np.concatenate([[0], np.cumsum(np.frombuffer(n, "<i8"))])
                    rate = 0.01 if number < ROUNDS // 2 else 0.003
                    done = A.train(now.value, ids, bounds, rate=rate, seed=number, part=(number, ROUNDS))
                    numbers.append(shard)
                    weights.append(float(len(ids)))
                    packed.append(A.pack(done))
                    if len(packed) == AVERAGED_AT_ONCE:
                        yield mean(numbers, weights, packed)
                        numbers, weights, packed = [], [], []
            if packed:
                yield mean(numbers, weights, packed)

        schema = "shard bigint, weight double, params binary"
        trained = samples.mapInPandas(steps, schema)
        left = shards
        while left > 1:
            left = math.ceil(left / AVERAGED_AT_ONCE)
            trained = trained.groupBy(F.pmod("shard", F.lit(left)).alias("part")).applyInPandas(
                lambda frame: mean(frame["shard"], frame["weight"], frame["params"]), schema
            )
        params = A.unpack(stored(trained).first()["params"], shape)
    return params


def score(
    docs: DataFrame,
    tokenizer_path: str,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base and model log10 probability of every whole text.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelling_score)``; the last two are the same, the log10 probability of the whole
    text under the attention model alone. The model learns from the rows where ``held_out`` is false. Tokens are the words
    between ASCII white space and one end of text; the base is a smoothed unigram
    over them. A null text is empty (one token, its end); a null id counts as an
    empty text in the split and stays null in the result. Repeated rows are scored
    each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, train_docs = chunked(docs, id_col, text_col, held_out)
    words = stored(word_counts(rows))
    totals = words.agg(
        F.coalesce(F.sum(F.when(F.col("first"), F.col("c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum((F.col("first") & (F.col("c") > 0)).cast("bigint")), F.lit(0)).alias("v"),
    ).first()
    train_tokens = totals["n"] + train_docs
    distinct = totals["v"] + (train_docs > 0)
    vocab = Shared(spark, Vocabulary(tokenizer_path))
    values, bounds, counts = model_vocabulary(words, vocab, train_docs)
    spelling = Shared(spark, (values, bounds))
    written_ids = stored(written(rows, words, vocab, spelling, train_docs, math.log10(train_tokens + distinct + 1)))
    params = Shared(spark, train_model(written_ids, vocab, spelling, counts))

    def scored(batches):
        for batch in batches:
            sizes = np.array([len(x) // 2 for x in batch["ids"]], np.int64)
            part = np.cumsum(sizes) // SCORED_IDS
            for mine in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
                ids = np.frombuffer(b"".join(batch["ids"].iloc[mine]), "<i2").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(sizes[mine])])
                logs = np.add.reduceat(A.token_logs(params.value, ids, at), at[:-1]) / np.log(10)
                out = batch.iloc[mine].drop(columns="ids")
                yield out.assign(train_tokens=train_tokens, score=logs, spelling_score=logs)

    schema = (
        "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double,"
        " train_tokens bigint, score double, spelling_score double"
    )
    # As many tasks as there are shards, whatever the sizes of the files.
    dealt = written_ids.drop("key").repartition(max(1, math.ceil(int(counts.sum()) / SHARD_TOKENS)))
    result = dealt.mapInPandas(scored, schema).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelling_score"
    )
    return result.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
