"""Labelled samples and hashed features, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import _BYTE, Words, mix, powers

#: Characters of all texts of a sample together.
SAMPLE_CHARS = 100_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id, which has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most `limit` labelled documents that aren't held out, in order of a hash of their ids.

    Null labels don't count; of labels that repeat an id the greatest counts, and of texts that repeat it the least, so
    that the sample is the same in every run. Of the chosen rows, the first whose texts have at most `chars` characters
    together come to the driver, each with its whole text; the first row always does.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most `limit` ids and numbers are broadcast.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("doc_id", F.length("text").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    within = sizes.where(F.col("before") + F.col("size") <= chars).unionByName(sizes.where((F.col("before") == 0) & (F.col("size") > chars))).select("doc_id")
    found = rows.join(F.broadcast(within), "doc_id").select("text", "_y", "doc_id").toArrow().sort_by("doc_id")
    return list(zip(found["text"].to_pylist(), found["_y"].to_pylist(), strict=True))


def grams(data: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every n characters within a word of UTF-8 `data`; those at a word's start differ from those elsewhere."""
    first = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    a, b = np.searchsorted(first, w.start), np.searchsorted(first, w.end)
    count = np.maximum(b - a - n + 1, 0)
    word = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    start, end = first[a[word] + place], np.append(first, len(data))[a[word] + place + n]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (place == 0), n), word
