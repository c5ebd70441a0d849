"""Names for SQL text: conversion as a scalar function, and pages of documents as a table function.

    register(spark, slots)
    spark.sql("SELECT inkstone_convert(text, 't2tw') FROM docs")
    spark.sql("SELECT * FROM inkstone_pages(TABLE(pages) PARTITION BY doc ORDER BY page)")

The table function sees a document's rows in their order, with a state of a few numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession, functions as F

from inkstone.operators.matching import matchers, replace_all
from inkstone.plans.conversion import ROUNDS, plan

Slots = Mapping[str, Mapping[str, str]]


def convert_by_name(spark: SparkSession, slots: Slots, punctuation: bool = False):
    """A function (text, config): each text in the script of its row's configuration, whose name may have any case.

    Null texts and null configurations give null; a name that isn't a configuration with all its slots there is an error.
    """
    there = {c: [r.pairs for r in plan(c, slots, punctuation)] for c, rounds in ROUNDS.items() if all(s in slots for r in rounds for s in r)}
    key = hashlib.sha256(json.dumps([[c, [list(r.items()) for r in rounds]] for c, rounds in there.items()]).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(there)

    @F.arrow_udf("string")
    def run(texts: pa.Array, configs: pa.Array) -> pa.Array:
        names = pc.utf8_lower(pc.utf8_trim_whitespace(configs))
        parts, places = [], []
        for name in pc.unique(names):
            wanted = pc.is_null(names) if not name.is_valid else pc.fill_null(pc.equal(names, name), False)
            places.append(pc.indices_nonzero(wanted))
            if not name.is_valid:
                parts.append(pa.nulls(len(places[-1]), pa.string()))
                continue
            config = name.as_py()
            if config not in shared.value:
                raise ValueError(f"no configuration with all its slots: {config!r}")
            parts.append(replace_all(texts.filter(wanted), matchers(f"{key}:{config}", lambda c=config: shared.value[c])).cast(pa.string()))
        if not parts:
            return pa.nulls(0, pa.string())
        return pa.concat_arrays(parts).take(pc.array_sort_indices(pa.concat_arrays(places)))

    return run


class Pages:
    """Rows (doc, page, n_pages, text) of a document in order: (doc, position from 1, start, piece).

    The pieces put together are the document's text; `start` counts the characters before one. With `n_pages` each page is
    announced, where it is null pages only end with a line end. A null text is empty.
    """

    def __init__(self) -> None:
        self.position, self.start = 0, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.position += 1
        text = row["text"] or ""
        piece = f"{text}\n" if row["n_pages"] is None else f"=== [Page {self.position}/{row['n_pages']}] ===\n\n{text}\n\n"
        yield row["doc"], self.position, self.start, piece
        self.start += len(piece)


def register(spark: SparkSession, slots: Slots, punctuation: bool = False) -> None:
    """Registers `inkstone_convert(text, config)` and `inkstone_pages(TABLE ...)` in the session."""
    spark.udf.register("inkstone_convert", convert_by_name(spark, slots, punctuation))
    spark.udtf.register("inkstone_pages", F.udtf(Pages, returnType="doc bigint, position int, start bigint, piece string"))
