"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words (runs without white space, case kept), the pairs of consecutive words, and the 3- to
5-character n-grams of each word. They are hashed into buckets with learned vectors. A word that repeats the one before,
and one whose 5-word window came before in the text, are features too (MARKS): a mean of vectors can't tell repetition from
the repeated words alone, as it doesn't change when a text is doubled. The mean of a text's vectors goes through a softmax
layer. As the layer is linear, a bucket's part in the score is one number, so scoring is a mean of looked-up numbers
over the whole text.

Training is plain stochastic gradient descent on the cross entropy, a text at a time, with the gradient's own direction in
every parameter; each bucket and the layer have a step of their own, the rate by the root of the squared gradients so
far, as rare buckets would hardly move otherwise.

The model is fitted in the driver on a labelled sample that is bounded in rows and characters; all other work is spread over
the documents' rows. Edge cases: a null or empty text has no features and gets the score of the bias alone; with labels of
one class, or none, every score is their mean or 0.5; repeated rows, null ids and extra columns pass through (result
columns replace columns of the same name); an empty table gives no rows. A text of any length is read whole, in the
memory of its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .labelled import grams, held_out, sample
from .scan import SPACED, chunks, scan, windows

BITS = 17
DIMENSIONS = 8
EPOCHS = 4
LIMIT = 6000
RATE = 0.3
SIZES = (3, 4, 5)
MARKS = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int, marks: bool = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of a chunk; the marks have buckets of their own after the hashed ones."""
    w = scan(data, offsets, SPACED, lower=False)
    slot = lambda h: h >> np.uint64(64 - bits)
    beside = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    bucket, doc = [slot(w.hash), slot(windows(w.hash, 2)[beside])], [w.doc, w.doc[beside]]
    for n in SIZES:
        h, word = grams(data, w, n)
        bucket.append(slot(h))
        doc.append(w.doc[word])
    if marks:
        twice = beside[w.hash[beside + 1] == w.hash[beside]] + 1
        five = windows(w.hash, 5)
        whole = np.flatnonzero(w.doc[4:] == w.doc[:-4]) if len(five) else np.zeros(0, np.int64)
        order = whole[np.lexsort((five[whole], w.doc[whole]))]
        again = order[1:][(five[order[1:]] == five[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])]
        for k, at in enumerate((twice, again)):
            bucket.append(np.full(len(at), (1 << bits) + k, np.uint64))
            doc.append(w.doc[at])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(doc)


@dataclass
class Model:
    part: np.ndarray  # what each bucket adds to the score
    bias: float
    bits: int
    marks: bool = MARKS

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a, b, data, offsets in chunks(texts):
            bucket, doc = features(data, offsets, self.bits, self.marks)
            total = np.bincount(doc, self.part[bucket], b - a) / np.maximum(np.bincount(doc, minlength=b - a), 1)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def shares(texts: pa.Array, bits: int, marks: bool = MARKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, what share of its features is in each) of each text."""
    for a, b, data, offsets in chunks(texts):
        bucket, doc = features(data, offsets, bits, marks)
        found, n = np.unique(doc * (2 << bits) + bucket, return_counts=True)
        cut = np.searchsorted(found >> (bits + 1), np.arange(b - a + 1))
        for x, z in zip(cut[:-1], cut[1:], strict=True):
            share = n[x:z].astype(np.float32)
            yield (found[x:z] & ((2 << bits) - 1)).astype(np.int32), share / max(share.sum(), 1)


def gradients(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The cross entropy of one text, and its gradients by the text's vectors, the layer and the bias."""
    hidden = share @ vectors if len(share) else np.zeros(layer.shape[1], layer.dtype)
    logits = layer @ hidden + bias
    odds = np.exp(logits - logits.max())
    odds /= odds.sum()
    error = odds.astype(layer.dtype)
    error[label] -= 1
    return -float(np.log(max(odds[label], 1e-30))), np.outer(share, layer.T @ error), np.outer(error, hidden), error


def fit(rows: list[tuple[str, int]], bits: int = BITS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1, marks: bool = MARKS) -> Model:
    y = np.array([label for _, label in rows], float)
    size = (1 << bits) + 2
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size), float(np.log(mean / (1 - mean))), bits, marks)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (size, dimensions)).astype(np.float32)
    layer, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    # Squared gradients so far: one number for a bucket, one for each parameter of the layer.
    of_vectors, of_layer, of_bias = np.zeros(size, np.float32), np.zeros_like(layer), np.zeros_like(bias)
    counted = list(shares(pa.array([t for t, _ in rows], pa.string()), bits, marks))
    small = np.float32(1e-12)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            bucket, share = counted[k]
            _, by_vectors, by_layer, by_bias = gradients(vectors[bucket], layer, bias, share, int(y[k]))
            of_layer += by_layer**2
            of_bias += by_bias**2
            layer -= rate * by_layer / np.sqrt(of_layer + small)
            bias -= rate * by_bias / np.sqrt(of_bias + small)
            if len(bucket):
                own = of_vectors[bucket] + np.einsum("ij,ij->i", by_vectors, by_vectors)
                of_vectors[bucket] = own
                vectors[bucket] -= (rate / np.sqrt(own + small))[:, None] * by_vectors
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]), bits, marks)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LIMIT, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """`docs` with held_out, score and predicted. The model is broadcast: 8 bytes for each of its 2^BITS buckets."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(sample(docs, labels, label, limit)))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.value.scores(batch.column("text")))], [*kept, "score"])

    out = docs.select(*kept).mapInArrow(apply, schema)
    out = out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
    return out if keep_text else out.drop("text")
