"""Registered queries of the pipeline operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_text,
    line_dedup,
    lm_scoring,
    periodic_runs,
    personal_data,
    quality,
    reply_trees,
    secret_ledger,
    simhash,
    whitening,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, TOKENIZER, lm_scoring.remainder(F.col("doc_id"), 7) == 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, lm_scoring.remainder(F.col("doc_id"), 4) == 2)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that leaks into it."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("doc")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_ledger.new_ledger(spark)
    found = secret_ledger.scan(_table(spark, sf_dir, "documents"), ledger, ("doc_id",))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_ledger.BASE_RULES]))
    counts = [secret_ledger.count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secret_ledger.BASE_RULES]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
        secret_ledger.listed(F.col("spans")).alias("spans"),
    )


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as trees of one branch, and one made of control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_last("turn"), "role", "text")
    rows = turns.union(more).withColumn("tree", tree).withColumn("node", F.row_number().over(order).cast("bigint"))
    rows = rows.select(
        "tree",
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
    done = reply_trees.format_trees(rows, top=1)
    loss = reply_trees.loss_text(F.col("formatted"), F.col("loss"))
    return done.select(
        F.nullif("tree", F.lit("")).cast("bigint").alias("conv_id"),
        reply_trees.count_turns(F.col("formatted")).alias("n_turns"),
        F.sha2(reply_trees.read_turns(F.col("formatted")), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later lines that match an earlier one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    strict = F.filter("spans", lambda s: s["strict"])
    counts = [F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(personal_data.span_list(strict), 256).alias("base_sha256"),
        personal_data.span_list(F.col("spans")).alias("spans"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """The documents, every tenth by hash with a tail whose words repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n, g = F.size(w[0]), F.floor(w[1] / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        bound = F.struct(w[0].alias("w"), a.alias("a"), p.alias("p"))
        return personal_data.let(
            bound,
            lambda b: F.array_join(
                F.transform(b["w"], lambda x, i: F.when(i < b["a"], x).otherwise(F.get(b["w"], b["a"] + (i - b["a"]) % b["p"]))), " "
            ),
        )

    pair = F.struct(words.alias("w"), h.alias("h"))
    changed = personal_data.let(pair, lambda w: F.when(F.size(w["w"]) > 0, repeated((w["w"], w["h"]))).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_periods(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.a")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_reply_trees": op6_reply_trees,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_text": op9_html_text,
    "op10_simhash": op10_simhash,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

#: Texts are equal after white space: every run of it is one space.
EXACT_DEDUP_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY t)
"""

#: The template is written out; nothing in the given texts needs escaping but the made-up conversation.
REPLY_TREES_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length(text) + CASE WHEN conv_id = -1 THEN 3 ELSE 0 END AS body FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 10 + body + 10 + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op6_reply_trees": REPLY_TREES_SQL,
    "op7_exact_dedup": EXACT_DEDUP_SQL,
}
