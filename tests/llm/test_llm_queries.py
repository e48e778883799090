"""Registered pipeline queries: SQL where there is some, and the pipeline against brute force."""

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sensorframe.llm import bpe, decontaminate, lm_scoring, quality, queries
from test_dedup import brute_components, brute_fingerprint, brute_lines
from test_text_operators import brute_leaks


def test_entry_registers_all():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert compare(frame, connect(sf_dir).sql(queries.ORACLES[name]).df()) is None


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = lm_scoring.remainder(F.col("doc_id"), 4) == 2
    good = {r.doc_id for r in quality.classify(docs, labels, held_out).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    texts = {i: t for i, (t, _) in brute_lines(sorted((i, r.text) for i, r in rows.items())).items()}
    least = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute_leaks(sorted(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    vocab = bpe.Vocabulary(corpus_pipeline.TOKENIZER)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in found} == {
        i: (t, rows[i].lang, rows[i].source, len(t)) for i, t in texts.items()
    }
    for r in found[:20]:
        assert bpe.decode_ids(np.array(r.ids), vocab) == r.text
    assert decontaminate.MIN_WORDS == 12


def test_stages_on_odd_documents(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f " * 900, None, "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(schema.names)] == schema.names, name
            assert number == len(corpus_pipeline.STAGES) - 1 or out.columns == schema.names
            out.collect()
