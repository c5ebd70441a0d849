"""Audit of how sources of a language differ: distances of all pairs of sources, and the terms that mark each source.

Every (lang, source) group, and every language, gives each kept term a smoothed share in parts of `SCALE`, by integers
only. A group's marking terms come from an upper-bound search: its terms lie in buckets of equal count, which have one
share p, and a bucket's smallest share in the language bounds p - q for all of its terms. Buckets are looked into from the
highest bound on: the first ones that hold `top` terms give the k-th value, then all that could still reach it; what is left
has bounds strictly below. Distances take the terms that both sources have from the posting lists of terms, and
all others from the buckets, where one side's share is that of a count of zero.

Memory: counts are added up in tasks, in dictionaries of at most `ENTRIES` terms, and then by Spark. A posting list has at
most a language's sources, of which the result holds all pairs. Nothing is collected.

Edge cases: null text, lang and source are empty; a text without terms still makes its group; a language whose terms are all
rare has value 0 for each pair and no marking terms; repeated rows are documents of their own, null or repeated ids
don't matter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

SCALE = 1_000_000_000
SMOOTHING = 5
MIN_DOCS = 30
TOP = 50
ENTRIES = 400_000

#: Each byte as part of a term, A-Z as a-z, or else a space: letters and whatever is not ASCII are terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of their documents by group; a group itself is a row without a term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *(t.decode() for t in n)]
            numbers = [[0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        lang, source = (batch.column(k).to_pylist() for k in (0, 1))
        for k, (a, b) in enumerate(zip(lang, source, strict=True)):
            text = batch.column(2)[k].as_buffer()
            n, docs = groups.setdefault((a, b), (Counter(), Counter()))
            terms = (text.to_pybytes() if text is not None else b"").translate(_TERM_BYTES).split()
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > ENTRIES:
                yield from told()
                groups, held = {}, 0
    yield from told()


def share(n: str, total: str, size: str, smoothing: int) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * size)), by long division so that no product overflows."""
    below, rest, parts = f"({total} + {smoothing} * {size})", f"({n} + {smoothing})", []
    for _ in range(3):
        parts.append(f"({rest} * 1000L) div {below}")
        rest = f"(({rest} * 1000L) % {below})"
    return F.expr(f"1L + ({parts[0]}) * 1000000L + ({parts[1]}) * 1000L + ({parts[2]})")


def _postings(docs: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, n_lang, first) of kept terms; and (lang, source, number, total, lang_total, size) of groups,
    with the number of kept terms as `size`."""
    counts = scratch.table("counts", docs.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    known = counts.where("term is not null").select("*", F.sum("docs").over(of_term).alias("all_docs"), F.sum("n").over(of_term).alias("n_lang"), (F.col("source") == F.min("source").over(of_term)).alias("first"))
    postings = scratch.table("postings", known.where(F.col("all_docs") >= min_docs).drop("docs", "all_docs"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = groups.select("lang", "source", F.row_number().over(of_lang.orderBy("source")).alias("number"), zero(F.col("total")).alias("total"), zero(F.sum("total").over(of_lang)).alias("lang_total"), zero(F.sum("firsts").over(of_lang)).alias("size"))
    return postings, scratch.table("groups", groups)


def _terms(postings: DataFrame, buckets: DataFrame, top: int, smoothing: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value) of the `top` kept terms of each group with the largest p - q above zero."""
    group = Window.partitionBy("lang", "source")
    bound = buckets.withColumn("bound", F.col("p") - share("least", "lang_total", "size", smoothing)).where("bound > 0")
    seen = F.coalesce(F.sum("n_terms").over(group.orderBy(F.col("bound").desc(), "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bound = scratch.table("bounds", bound.select("lang", "source", "n", "p", "lang_total", "size", "bound", (seen < top).alias("early")))
    best = group.orderBy(F.col("value").desc(), "item")

    def looked_into(some: DataFrame) -> DataFrame:
        found = postings.join(some, ["lang", "source", "n"]).withColumn("value", F.col("p") - share("n_lang", "lang_total", "size", smoothing))
        return found.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")).alias("rank")).where(F.col("rank") <= top)

    early = scratch.table("early", looked_into(bound.where("early")))
    kth = early.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    late = bound.where("not early").join(kth, ["lang", "source"], "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0))).drop("kth")
    return early.union(looked_into(late)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _pairs(postings: DataFrame, buckets: DataFrame, groups: DataFrame, smoothing: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    side = groups.select("lang", "number", "source", "total", "size").withColumn("z", F.when(F.col("size") > 0, share("0L", "total", "size", smoothing)).otherwise(0))
    a, b = (side.select("lang", F.col("number").alias(x), F.col("source").alias(f"source_{x}"), F.col("z").alias(f"z{x}"), *["size"] * (x == "a")) for x in "ab")
    # Terms of one source, as if the other had none: by bucket.
    other = b.select("lang", "b", "zb")
    mine = buckets.join(side.select("lang", "source", F.col("number").alias("a"), F.col("z").alias("za")), ["lang", "source"]).select("lang", "a", "za", "p", "n_terms")
    gap = F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("za") - F.col("zb"))
    alone = mine.join(other, "lang").where("a <> b").groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("n_terms") * gap).alias("alone"))
    # Terms of both: what the two of them said above is put right.
    rated = postings.join(side, ["lang", "source"]).select("lang", "term", F.struct("number", share("n", "total", "size", smoothing).alias("p"), "z").alias("x"))
    lists = rated.groupBy("lang", "term").agg(F.collect_list("x").alias("xs"))
    one = lists.select("lang", "xs", F.explode("xs").alias("u"))
    two = one.select("lang", "u", F.explode(F.filter("xs", lambda v: v["number"] > F.col("u.number"))).alias("v"))
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    mend = far("u.p", "v.p") - far("u.p", "v.z") - far("u.z", "v.p") + far("u.z", "v.z")
    both = two.groupBy("lang", F.col("u.number").alias("a"), F.col("v.number").alias("b")).agg(F.sum(mend).alias("both"))
    pairs = a.join(b, "lang").where("a < b").join(alone, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.col("size") * far("za", "zb") + F.coalesce("alone", F.lit(0)) + F.coalesce("both", F.lit(0))
    pairs = scratch.table("pairs", pairs.select("lang", "source_a", "source_b", value.alias("value")))
    turned = lambda x, y: pairs.select("lang", F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), "value")
    return turned("a", "b").union(turned("b", "a")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, smoothing: int = SMOOTHING, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by distance (`pair`), and
    the `top` terms whose share is most above the language's (`term`).

    A term is a run of letters and of characters beyond ASCII, A-Z in small letters; those in at least `min_docs`
    documents of a language are kept.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    postings, groups = _postings(rows, min_docs, scratch)
    buckets = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("n_terms"), F.min("n_lang").alias("least"))
    buckets = buckets.join(groups.drop("number"), ["lang", "source"]).withColumn("p", share("n", "total", "size", smoothing))
    buckets = scratch.table("buckets", buckets)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(_pairs(postings, buckets, groups, smoothing, scratch), "pair").union(part(_terms(postings, buckets, top, smoothing, scratch), "term"))
