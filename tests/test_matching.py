"""The kernel over Arrow buffers against a plain scan of one text."""

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkstone.operators import matching
from inkstone.operators.convert import by_character, convert, replace_greedy, replacer
from inkstone.operators.matching import Edges, Matcher, replace_all

ALPHABET = "abc漢字é\U0002003e\U0001f600"
PAIRS = st.dictionaries(st.text(ALPHABET, min_size=1, max_size=5), st.text(ALPHABET + "X", max_size=4), max_size=12)
TEXTS = st.lists(st.none() | st.text(ALPHABET + " z", max_size=40), max_size=8)


@settings(max_examples=300, deadline=None)
@given(PAIRS, TEXTS, st.sampled_from([1, 20, 1 << 19]), st.sampled_from([pa.string(), pa.large_string()]))
def test_kernel_equals_the_scan(pairs, texts, chunk, kind):
    # Identities block shorter keys.
    pairs |= {k: k for k in list(pairs)[:2]}
    replace, before = replacer(pairs), matching.CHUNK_BYTES
    matching.CHUNK_BYTES = chunk
    try:
        got = replace_all(pa.array(["ab", *texts, None], kind).slice(1, len(texts)), [Matcher(pairs)])
    finally:
        matching.CHUNK_BYTES = before
    assert got.type == pa.string() and got.to_pylist() == [None if t is None else replace(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(PAIRS, PAIRS, TEXTS)
def test_rounds_follow_each_other(one, two, texts):
    got = replace_all(pa.array(texts, pa.string()), [Matcher(one), Matcher(two)])
    assert got.to_pylist() == [None if t is None else replacer(two)(replacer(one)(t)) for t in texts]


@pytest.mark.parametrize("n", [2, 3, 7, 64])
def test_chains_of_overlaps(n):
    """A text that is one cluster of overlapping matches."""
    pairs = {"a" * n: "1", "aab": "2", "ba": "3"}
    texts = ["a" * 1001, "aab" * 500 + "a", "ab" * 700]
    assert replace_all(pa.array(texts), [Matcher(pairs)]).to_pylist() == list(map(replacer(pairs), texts))


def test_ten_thousand_pairs():
    han = [chr(0x4E00 + k) for k in range(101)]
    pairs = {a + b: b + a for a in han for b in han if a != b} | {a + b + a: "三" for a in han for b in han[:9] if a != b}
    assert len(pairs) > 10_000
    text = "".join(han[k * k % 101] for k in range(5000))
    assert replace_all(pa.array([text]), [Matcher(pairs)]).to_pylist() == [replacer(pairs)(text)]


def test_edges_with_collisions():
    edges = {(k % 37, k): k + 1 for k in range(1, 3000)}
    import numpy as np

    found = Edges(edges)
    nodes, codes = np.array([k % 37 for k in range(1, 4000)]), np.arange(1, 4000, dtype=np.uint32)
    assert found.follow(nodes, codes).tolist() == [edges.get((n, c), 0) for n, c in zip(nodes.tolist(), codes.tolist(), strict=True)]


def test_lone_delimiters(spark):
    """A delimiter after another, or first in a text, stays as it is, also where its value has another length."""
    slots = [{"。": "..", "！": "!", "a。": "A", "b": "B"}]
    df = spark.createDataFrame([("。a。。！b！",), ("a！。",), (None,)], "t string")
    assert [r[0] for r in df.select(replace_greedy(spark, F.col("t"), slots, 3)).collect()] == ["。A。！B!", "a!。", None]


def test_by_character(spark):
    """Each code point alone, however long the keys of other slots are; astral ones too."""
    df = spark.createDataFrame([("汉字𠀾",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(by_character(F.col("t"), {"汉": "漢", "𠀾": "x"})).collect()] == ["漢字x", "", None]


def test_many_batches(spark):
    slots = {"tw_variants": {"a": "bb", "c": "d"}, "tw_variants_phrases": {"aca": "X", "zz": ""}}
    df = spark.range(0, 25_000, 1, 3).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.repeat(F.lit("ac"), (F.col("id") % 5).cast("int")), F.lit("zz漢"))).alias("t"))
    replace = replacer({"a": "bb", "c": "d", "aca": "X", "zz": ""})
    for r in df.select("t", convert(spark, F.col("t"), "t2tw", slots).alias("x")).distinct().collect():
        assert r.x == (None if r.t is None else replace(r.t))
