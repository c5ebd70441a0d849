"""The audit of sources against brute force by exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from inkstone.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int"


def brute(rows, min_docs, top):
    occurs, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        groups.add((lang, source))
        occurs[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((occurs[lang, s] for s in sources), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(occurs[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if occurs[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def made(seed, n=260):
    r = random.Random(seed)
    words = [f"w{a}{b}" if a != "é" else f"{a}{b}Ä" for a in "abcdefgé" for b in "xyzuv"] + ["The", "THE", "ſ", "中文"]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["s0", "s0", "s0", "s1", "s2", "Ω", None, ""])
        use = words[: r.randrange(2, len(words))]
        rows.append((" ".join(r.choice(use) for _ in range(r.randrange(0, 40))) + r.choice(["", " 12", "-x", "_y"]), lang, source))
    rows += [(None, "fr", "s0"), ("only rare words", "fr", "s1"), ("only rare words", "fr", "s1"), ("", "it", "s9"), ("q " * 9000, "en", "s1")]
    return rows


def check(spark, rows, monkeypatch=None, **more):
    table = spark.createDataFrame([(None, *r, "clash", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in divergence.audit(table, **more).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, more["min_docs"], more["top"])


@pytest.mark.parametrize("min_docs, top", [(30, 50), (4, 3), (1, 1)])
def test_against_brute_force(spark, min_docs, top):
    check(spark, made(top), min_docs=min_docs, top=top)


def test_counts_leave_in_parts(spark, monkeypatch):
    out = list(divergence._count(iter([_batch([("a b a", "en", "s"), ("b c", "en", "s")])])))
    assert sum(b.num_rows for b in out) == 4
    monkeypatch.setattr(divergence, "ENTRIES", 1)
    parts = list(divergence._count(iter([_batch([("a b a", "en", "s"), ("b c", "en", "s")])])))
    assert len(parts) > 1
    total = Counter()
    for b in parts:
        for x in b.to_pylist():
            total[x["term"]] += x["n"]
    assert total == Counter({"a": 2, "b": 2, "c": 1, None: 0})


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (1, 2, 0)], ["lang", "source", "text"])


def test_shares_of_large_counts_are_exact(spark):
    n, total, size = 3 * 10**14, 7 * 10**15, 10**6
    df = spark.range(1).selectExpr(f"{n}L as n", f"{total}L as total", f"{size}L as size")
    assert df.select(divergence.share("n", "total", "size", 5)).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * size)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
