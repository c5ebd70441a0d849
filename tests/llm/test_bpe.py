"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from inkstone.llm import bpe  # noqa: E402
from inkstone.llm.queries import op11_bpe_encode_decode, tokenizer_path  # noqa: E402

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_against_library(spark, library):
    where = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = op11_bpe_encode_decode(spark, where).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id])


LONG = [
    "a" * 10_000,
    "ab" * 3_001 + "b" * 777,
    "".join(chr(97 + k * k % 26) for k in range(20_000)),
    "x " + "".join(chr(0x4E00 + k * 37 % 900) for k in range(6_000)) + "!?" * 2_000 + " end",
    "=" * 9_001 + "\n" + "0123456789" * 900 + " " * 5_000 + "é" * 4_500,
    "\U0001f600\U0001f601" * 3_000,
    "before <|endoftext|><|endoftext|>" + "q" * 5_000 + "<|endoftext|>",
    "ſ" * 4_200 + "’t " + "́" * 4_200,
]


@pytest.mark.parametrize("leaf", [16, 100, 4096])
def test_long_stretches(spark, library, leaf):
    rows = [(k, t) for k, t in enumerate(LONG)] + [(None, LONG[1]), (7, None), (7, None), (9, ""), (10, "short <|endoftext|>")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, row int, part string")
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.doc_id is None) for r in bpe.encode_documents(docs, PATH, leaf=leaf).collect())
    assert got == sorted((*digests(library, t), k is None) for k, t in rows)


def test_real_outputs(spark, library):
    docs = spark.createDataFrame([("a", "Some text, and more."), ("b", "z" * 5_000)], "doc_id string, text string")
    for r in bpe.encode_documents(docs, PATH).collect():
        text = {"a": "Some text, and more.", "b": "z" * 5_000}[r.doc_id]
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode_documents(docs, PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abtheingxé中\U0001f600", min_size=2, max_size=300), st.integers(1, 40))
def test_join_of_parts_is_the_whole(text, leaf):
    codec = bpe.codec(PATH)
    merged = lambda s: np.array(codec.encoder.merges.encode_ordinary(s), np.uint32)
    parts = bpe.halved(text, leaf)
    assert "".join(parts) == text
    assert codec.concatenate([merged(p) for p in parts]).tolist() == merged(text).tolist()
