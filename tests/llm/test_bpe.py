"""BPE against the tokenizers library, which is the brute-force version here."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sensorframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "",
    " ",
    "  a  b ",
    "a\n \nb",
    "aaaaaaa",
    "it's we'll 12 ２ ½",
    "<|endoftext|> x<|endoftext|>",
    "é  中😀",
    "\x00\x1c\x85",
    "x" * 5000,
    "a b " * 3000,
]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's\n\té1２ 　😀<|endoftext>."), max_size=30), max_size=6))
def test_ids_are_those_of_the_library(vocab, library, texts):
    ids, bounds = bpe.encode_texts(texts, vocab)
    for text, mine in zip(texts, np.split(ids, bounds[1:-1])):
        assert mine.tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(mine, vocab) == library.decode(mine.tolist(), skip_special_tokens=False)


def test_whole_table(spark, vocab, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    found = bpe.round_trip(docs, PATH).collect()
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_encode_keeps_columns_and_decodes(spark):
    docs = spark.createDataFrame([(1, "a b", 2**60), (None, None, None)], "doc_id bigint, text string, n bigint")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [(r.doc_id, r.text, r.n, r.decoded) for r in out] == [(1, "a b", 2**60, "a b"), (None, None, None, "")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_blocks_do_not_change_ids(vocab, monkeypatch):
    whole = [x.tolist() for part in bpe.encode_blocks(ODD, vocab) for x in part]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3)
    assert [x.tolist() for part in bpe.encode_blocks(ODD, vocab) for x in part] == whole
