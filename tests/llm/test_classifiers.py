"""The two classifiers against brute force, from texts to scores, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import classifier, labelled, toxicity

DOCS = "doc_id bigint, text string"


def text(rng, n, words):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def examples(rng, n, words=300):
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.3
        rows.append((text(rng, rng.randrange(1, 60), words) + (" Idiot trash" if bad and rng.random() < 0.8 else " fine day"), int(bad)))
    return rows + [("", 1), ("  ", 0), rows[0], rows[0]]


def brute_scores(rows, texts, k):
    """Scores by comparing each text with every example."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    n, n1 = len(rows), sum(y for _, y in rows)
    df, ones = Counter(), Counter()
    for t, y in rows:
        for w in set(words(t)):
            df[w] += 1
            ones[w] += y

    def weight(w):
        a, b, c, d = ones[w] + 0.5, df[w] - ones[w] + 0.5, n1 - ones[w] + 0.5, n - n1 - df[w] + ones[w] + 0.5
        odds = abs(math.log(a * d / b / c))
        s = (odds / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) ** toxicity.POWER
        return math.log(1 + n / df[w]) * odds * s / (s + toxicity.SURE**toxicity.POWER)

    def vector(t):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in Counter(words(t)).items() if w in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors, prior, out = [vector(t) for t, _ in rows], n1 / n, []
    blank = [y for (t, y), v in zip(rows, vectors, strict=True) if not v]
    for t in texts:
        v = vector(t)
        near = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), y) for u, (_, y) in zip(vectors, rows, strict=True)), reverse=True)
        near = [x for x in near if x[0] > 0]
        if not near:
            out.append({(sum(blank) + prior) / (len(blank) + 1)})
            continue
        # Of equally near examples at the end any may count.
        sure = [x for x in near[:k] if x[0] > near[min(k, len(near)) - 1][0] + 1e-6]
        ties = [x for x in near if abs(x[0] - near[min(k, len(near)) - 1][0]) <= 1e-6]
        room = min(k, len(near)) - len(sure)
        ones_ = sum(y for _, y in ties)
        low, high = max(0, room - (len(ties) - ones_)), min(room, ones_)
        total = sum(x * x for x, _ in sure) + room * ties[0][0] ** 2 + 0.2
        out.append({(sum(x * x * y for x, y in sure) + m * ties[0][0] ** 2 + 0.2 * prior) / total for m in range(low, high + 1)})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_against_every_example(seed):
    rng = random.Random(seed)
    rows = examples(rng, 250)
    texts = [t for t, _ in examples(rng, 60)] + [None, "unknown words only", "IDIOT"]
    index = toxicity.build(rows)
    got = [index.judge(t, w, 7)[0] for t, w in index.vectors(pa.array(texts))]
    for score, may in zip(got, brute_scores(rows, [t or "" for t in texts], 7), strict=True):
        assert min(abs(score - m) for m in may) < 1e-4


def test_rare_toxic_words_count():
    """A word that only three examples have, all toxic, decides where nothing more certain stands."""
    rng = random.Random(3)
    rows = [(text(rng, 30, 200), 0) for _ in range(300)] + [(text(rng, 30, 200) + " zounds", 1) for _ in range(3)]
    index = toxicity.build(rows)
    (term, w), = index.vectors(pa.array(["what zounds this"]))
    assert index.judge(term, w, 3)[0] > 0.5
    assert toxicity.build([]).judge(np.zeros(0, np.int64), np.zeros(0), 3) == (0.0, [], [])


def test_classifier_forward_and_gradient():
    """Scores against features counted by hand, and every gradient against differences of the loss."""
    t = "ab\u00e9c ab\u00e9c x\u6587\u5b57y"
    words = t.split()
    n = len(words) + len(words) - 1 + sum(max(0, len(w) - k + 1) for w in words for k in classifier.SIZES) + 1
    (bucket, share), = classifier.shares(pa.array([t]), 12)
    assert np.isclose(share.sum(), 1) and np.isclose(share[bucket == 1 << 12], 1 / n)
    rng = np.random.default_rng(0)
    model = classifier.Model(rng.normal(size=(1 << 12) + 2), 0.3, 12)
    assert np.allclose(model.scores(pa.array([t, None])), 1 / (1 + np.exp(-np.array([share @ model.part[bucket] + 0.3, 0.3]))))
    vectors, layer, bias = rng.normal(size=(len(bucket), 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    share = share.astype(float)
    for label in (0, 1):
        _, *by = classifier.gradients(vectors, layer, bias, share, label)
        for x, g in zip((vectors, layer, bias), by, strict=True):
            for at in np.ndindex(x.shape):
                was, losses = x[at], []
                for step in (1e-5, -1e-5):
                    x[at] = was + step
                    losses.append(classifier.gradients(vectors, layer, bias, share, label)[0])
                x[at] = was
                assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-6


def test_sample_is_fixed_and_bounded(spark):
    docs = spark.createDataFrame([(k, f"{v} text {k}") for k in range(50) for v in ("b", "a")] + [(None, "x"), (3, None)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, None), (None, 1), (2, 1)], "doc_id bigint, y int")
    rows = labelled.sample(docs, labels, "y", 100)
    held = {r[0] for r in spark.range(50).withColumnRenamed("id", "doc_id").where(labelled.held_out()).collect()}
    assert sorted(rows) == sorted([("" if k == 3 else f"a text {k}", 1 if k == 2 else k % 2) for k in range(50) if k not in held])
    few = labelled.sample(docs, labels, "y", 100, chars=40)
    assert set(few) < set(rows) and 0 < sum(len(t) for t, _ in few) <= 40
    assert len(labelled.sample(docs, labels, "y", 100, chars=1)) <= 2 and len(labelled.sample(docs, labels, "y", 5)) == 5


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (classifier, "quality")])
def test_clashing_columns_and_long_texts(spark, module, label):
    rng = random.Random(6)
    rows = [(k, t) for k, (t, _) in enumerate(examples(rng, 60))]
    docs = spark.createDataFrame([*rows, (None, None), (None, "x"), (500, "fine day " * 200_000), (7, rows[7][1])], DOCS)
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "held_out", "predicted", "evidence", "extra")})
    labels = spark.createDataFrame([(k, int(" fine" in t), int("trash" in t)) for k, t in rows], "doc_id bigint, quality int, toxic int")
    got = module.score(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["extra"] == "clash" for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
