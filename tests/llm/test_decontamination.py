"""The suffix array and its search against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import decontaminate
from inkstone.llm.scan import ALNUM, LOWER, chunks, scan


def shard(texts):
    ((_, _, data, offsets),) = chunks(pa.array(texts))
    return scan(data, offsets, ALNUM), LOWER[data]


def brute(docs, items, size):
    """Per document: its hit words, its longest match, its items."""
    out = []
    for doc in docs:
        w, hit, longest, own = doc.split(), set(), 0, set()
        for k, item in enumerate(items):
            v = item.split()
            n = min(size, len(v))
            for p in range(len(v) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    m = 0
                    while p + m < len(v) and q + m < len(w) and v[p + m] == w[q + m]:
                        m += 1
                    if m >= n:
                        hit |= set(range(q, q + m))
                        longest = max(longest, m)
                        own.add(k)
        out.append((hit, longest, own))
    return out


def got(docs, items, size):
    test = decontaminate.prepare([str(k) for k in range(len(items))], items, size)
    w, data = shard(docs)
    found, bounds = decontaminate.find(w, data, test), w.bounds()
    out = []
    for d in range(len(docs)):
        rows = found.pairs[found.pairs // len(test.ids) == d] % len(test.ids)
        hit = set(np.flatnonzero(found.hit[bounds[d] : bounds[d + 1]]).tolist())
        out.append((hit, int(found.longest[d]), {int(i) for r in rows for i in test.ids[r]}))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10])
@pytest.mark.parametrize("words", [2, 4, 300])
def test_find_against_brute_force(size, words):
    rng = random.Random(size * 1000 + words)
    some = lambda n: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    items = [some(n) for n in (0, 1, 2, size, size + 1, 14, 25)]
    items += [items[5], " ".join(["w1"] * 12)]
    docs = [some(rng.randrange(40)) for _ in range(8)]
    docs += [docs[0], items[6] + " " + some(5), some(3) + " " + items[5], " ".join(["w1"] * 30), "", " ".join(items[6].split()[:9])]
    assert got(docs, items, size) == brute(docs, items, size)


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    docs = [" ".join(f"w{rng.randrange(3)}" for _ in range(n)) for n in (60, 1, 0, 25)]
    w, _ = shard(docs)
    array, bounds = decontaminate.suffix_array(w, 10), w.bounds()
    first = [w.hash[p : min(p + 10, bounds[w.doc[p] + 1])].tolist() for p in array.order]
    assert sorted(array.order.tolist()) == list(range(len(w.hash))) and first == sorted(first)
    assert array.heads.tolist() == [k for k, x in enumerate(first) if not k or first[k - 1] != x] + [len(first)]


def test_words_are_compared_by_bytes():
    """A document's word with the hash of a test word isn't hit."""
    item = " ".join(f"w{k}" for k in range(12))
    test = decontaminate.prepare(["a"], [item])
    w, data = shard(["x0 " + item, item.replace("w5", "v5")])
    w.hash[13 + 5] = w.hash[1 + 5]
    found = decontaminate.find(w, data, test)
    assert found.longest.tolist() == [12, 0] and np.flatnonzero(found.hit).tolist() == list(range(1, 13))


def test_blocks_and_long_items(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate((12, 400, 30, 11))] + [(None, some(15)), (9, None)]
    docs = [(k, some(60) + " " + (items[k][1] or "") + " " + some(40)) for k in range(6)] + [(None, None), (None, some(3000))]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.find_matches(docs, items).drop("text").collect()
    assert sorted(map(str, decontaminate.find_matches(docs, items, block_bytes=100).drop("text").collect())) == sorted(map(str, whole))
    assert {r["doc_id"]: r["longest_match"] for r in whole if r["doc_id"] in (0, 1, 2, 3)} == {0: 12, 1: 400, 2: 30, 3: 11}
    assert decontaminate.find_matches(docs.limit(0), items).count() == 0
