"""Toxicity by the nearest labelled examples: cosine of weighted TF-IDF vectors over a block-max inverted index.

Features are words (runs of letters and digits, in small letters); all that the examples have are kept. A feature's weight is (1 + log tf) * idf, times how far the feature tells the labels apart, and
how surely: `log_odds * s**POWER / (s**POWER + SURE**POWER)`, where s is the log odds by its standard error. With idf alone the nearest
examples are those with the same common words: see the README for figures. Nothing is cut, so a word that few examples
have counts where a text has none of more certain ones.

The index has, for each feature and block of examples, the examples' weights and their maximum. For a document, blocks
are visited by the bound that the maxima give, until no block left can hold a nearer example than the k found, so the k
nearest are exact. Their labels, weighted by the square of the cosine and joined with the prior rate, make the score,
and the nearest examples are its evidence.

The index is built in the driver from a labelled sample, bounded in rows and characters, and is broadcast. Edge cases: a
document without known features, such as a null or empty text, gets the rate of label 1 among examples without features,
joined with the prior rate; without examples all scores are 0; repeated rows, null ids and extra columns pass through
(result columns replace columns of the same name); an empty table gives no rows. Of equally near examples the first
counts. A text of any length is read whole, in the memory of its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .labelled import held_out, sample
from .scan import ALNUM, chunks, scan

LIMIT = 6000
NEAREST = 15
BLOCK = 64
#: Blocks that are visited together.
GROUP = 8
SURE = 3.3
POWER = 12


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every feature of a chunk."""
    w = scan(data, offsets, ALNUM)
    return w.hash, w.doc


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range of each."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own], own


class Index:
    """Examples by place, and their postings (feature, place, weight), which are what is broadcast.

    Each task lays them out for the search: features that at least every second block has as rows over all places, the others
    as entries, pairs of a feature and a block of places, each with its postings in a row."""

    def __init__(self, features: np.ndarray, weight: np.ndarray, prior: float):
        self.features, self.weight, self.prior = features, weight, prior  # sorted hashes, and their weights
        self.blank = 0.0  # rate of label 1 among examples without features, joined with the prior
        self.label, self.example = np.zeros(0), np.zeros(0, np.int64)  # by place: the label, and the row of the sample
        self.raw = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("features", "weight", "prior", "blank", "label", "example", "raw")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.arrange()

    def arrange(self) -> None:
        term, place, value = self.raw
        term, blocks = term.astype(np.int64), len(self.label) // BLOCK
        by = np.lexsort((place, term))
        term, place, value = term[by], place[by].astype(np.int64), value[by]
        new = np.flatnonzero(np.diff(term * max(blocks, 1) + place // BLOCK, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        often = np.flatnonzero(2 * np.bincount(term[new], minlength=len(self.features)) >= blocks) if blocks > 1 else new[:0]
        self.row = np.full(len(self.features), -1)  # of each feature; -1 for those with entries
        self.row[often] = np.arange(len(often))
        row = self.row[term]
        grid = np.zeros((blocks, len(often), BLOCK), np.float32)
        dense = row >= 0
        grid[place[dense] // BLOCK, row[dense], place[dense] % BLOCK] = value[dense]
        self.row_value, self.row_most = grid, grid.max(axis=2, initial=0)
        term, self.place, self.value = term[~dense], place[~dense], value[~dense]
        new = np.flatnonzero(np.diff(term * max(blocks, 1) + self.place // BLOCK, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.posting = np.append(new, len(term))  # the first of each entry
        self.block = self.place[new] // BLOCK
        self.most = np.maximum.reduceat(self.value, new) if len(new) else np.zeros(0)  # the largest weight of an entry
        self.entry = np.searchsorted(term[new], np.arange(len(self.features) + 1))  # the first of each feature

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(features, weights) of each text, of length one."""
        for a, b, data, offsets in chunks(_lower(texts)):
            h, doc = features(data, offsets)
            at = np.minimum(np.searchsorted(self.features, h), max(len(self.features) - 1, 0))
            hit = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
            key, n = np.unique(doc[hit] * (len(self.features) + 1) + at[hit], return_counts=True)
            own, term = np.divmod(key, len(self.features) + 1)
            w = (1 + np.log(n)) * self.weight[term] if len(key) else np.zeros(0)
            cut = np.searchsorted(own, np.arange(b - a + 1))
            for x, z in zip(cut[:-1], cut[1:], strict=True):
                yield term[x:z], w[x:z] / np.linalg.norm(w[x:z]) if z > x else w[x:z]

    def nearest(self, term: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the k nearest examples, exactly; only those with something in common."""
        row = self.row[term]
        often = row >= 0
        row, w_often, term, w = row[often], w[often].astype(np.float32), term[~often], w[~often]
        entry, own = _ranges(self.entry[term], self.entry[term + 1])
        block, blocks = self.block[entry], len(self.row_most)
        # The rounding of single precision is far below the allowance.
        bound = (np.bincount(block, w[own] * self.most[entry], blocks) + self.row_most[:, row] @ w_often) * (1 + 1e-4)
        order = np.argsort(-bound, kind="stable")
        place, near = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, blocks, GROUP):
            group = order[at : at + GROUP]
            group = group[(bound[group] > 0) & (bound[group] >= (near[-1] if len(near) >= k else 0))]
            if not len(group):
                break
            slot = np.full(blocks, -1)
            slot[group] = np.arange(len(group))
            here = np.flatnonzero(slot[block] >= 0)
            posting, of = _ranges(self.posting[entry[here]], self.posting[entry[here] + 1])
            found = np.bincount(slot[block[here]][of] * BLOCK + self.place[posting] % BLOCK, w[own[here]][of] * self.value[posting], len(group) * BLOCK)
            found = found + (w_often @ self.row_value[group[:, None], row]).ravel()
            has = np.flatnonzero(found > 0)
            place, near = np.concatenate([place, group[has // BLOCK] * BLOCK + has % BLOCK]), np.concatenate([near, found[has]])
            top = np.lexsort((place, -near))[:k]
            place, near = place[top], near[top]
        return place, near

    def judge(self, term: np.ndarray, w: np.ndarray, k: int) -> tuple[float, list[int], list[float]]:
        place, near = self.nearest(term, w, k) if len(term) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(place):
            return self.blank, [], []
        vote = near**2
        score = (vote @ self.label[place] + 0.2 * self.prior) / (vote.sum() + 0.2)
        return float(score), self.example[place[:3]].tolist(), near[:3].tolist()


def weights(n: int, n1: int, df: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The weight of features that `df` of `n` examples have, and `ones` of the `n1` examples with label 1."""
    a, b, c, d = ones + 0.5, df - ones + 0.5, n1 - ones + 0.5, n - n1 - (df - ones) + 0.5
    odds = np.abs(np.log(a * d / (b * c)))
    sure = (odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) ** POWER
    return np.log(1 + n / np.maximum(df, 1)) * odds * sure / (sure + SURE**POWER)


def build(rows: list[tuple[str, int]]) -> Index:
    label = np.array([y for _, y in rows], float)
    texts = pa.array([t for t, _ in rows], pa.string())
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, _, data, offsets in chunks(_lower(texts)):
        h, doc = features(data, offsets)
        pair = np.unique(np.rec.fromarrays([h, doc + a], names="h,d"))
        hashes.append(pair.h)
        docs.append(pair.d)
    doc = np.concatenate(docs)
    found, number, df = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    ones = np.bincount(number, label[doc], len(found)) if len(doc) else np.zeros(0)
    prior = float(label.mean()) if len(label) else 0.0
    index = Index(found, weights(len(label), int(label.sum()), df, ones), prior)
    rated = list(index.vectors(texts))
    empty = np.array([not len(t) for t, _ in rated], bool)
    index.blank = float((label[empty].sum() + prior) / (empty.sum() + 1)) if len(label) else 0.0
    own = [k for k in range(len(rated)) if not empty[k]]
    # Examples with the same strongest feature lie together, which makes the blocks' bounds tight.
    own.sort(key=lambda k: (int(rated[k][0][np.argmax(rated[k][1])]), k))
    blocks = -(-len(own) // BLOCK)
    index.label, index.example = np.zeros(blocks * BLOCK), np.zeros(blocks * BLOCK, np.int64)
    index.label[: len(own)], index.example[: len(own)] = label[own], own
    if own:
        place = np.repeat(np.arange(len(own), dtype=np.int32), [len(rated[k][0]) for k in own])
        index.raw = np.concatenate([rated[k][0] for k in own]).astype(np.int32), place, np.concatenate([rated[k][1] for k in own]).astype(np.float32)
    index.arrange()
    return index


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT, k: int = NEAREST, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """`docs` with held_out, score, predicted and evidence: the nearest examples' rows in the sample and similarities."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(build(sample(docs, labels, label, limit)))
    new = [T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("similarities", T.ArrayType(T.DoubleType()))]
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "evidence", "similarities")]
    schema = T.StructType([docs.schema[c] for c in kept] + new)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [index.value.judge(t, w, k) for t, w in index.value.vectors(batch.column("text"))]
            made = [pa.array([x[0] for x in own], pa.float64()), pa.array([x[1] for x in own], pa.list_(pa.int64())), pa.array([x[2] for x in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "score", "evidence", "similarities"])

    out = docs.select(*kept).mapInArrow(apply, schema)
    out = out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
    return out if keep_text else out.drop("text")
