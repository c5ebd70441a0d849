"""Cases that the other tests of the operators lack."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import chat, jaccard, licenses, pii, quality_rules, urls
from inkstone.llm.graph import components
from inkstone.llm.scratch import Scratch

DOCS = "doc_id bigint, text string"


def run(source, **names):
    return "".join(t for t, _ in chat.compile_template(source)(**names))


def test_template_scope_and_white_space():
    nested = "{% for a in xs %}{% for b in a %}{{ b }}{% endfor %}{% if not loop.last %};{% endif %}{% endfor %}"
    assert run(nested, xs=[[1, 2], [3], [4]]) == "12;3;4"
    assert run("{% for a in xs %}{% endfor %}{{ a }}{{ loop.index }}", xs=[1], a="o") == "o"
    assert run("a {{- ' b ' -}}  c\n{%- if x -%}\n d {% endif -%} e{#- no -#} f", x=1) == "a b cd ef"
    assert run("{{ '}}' + '%}' }}{{ \"a'}}\" }}") == "}}%}a'}}"
    assert run("{{ 1 < 2 }}{{ 'a' in 'cat' }}{{ 'k' in m }}{{ 3 not in l }}{{ l[1] }}{{ l | length }}{{ ' x ' | trim | upper }}{{ 'a' < 1 }}", m={"k": 1}, l=[1, 2]) == "TrueTrueTrueTrue22XFalse"


def test_template_limits():
    deep = ["{{ " + "(" * 999 + "1" + ")" * 999 + " }}", "{{ " + "not " * 999 + "1 }}", "{{ 1" + " + 1" * 999 + " }}", "{{ a" + ".a" * 999 + " }}", "{% if a %}" * 999 + "{% endif %}" * 999]
    for source in deep:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)
    with pytest.raises(chat.TemplateError):
        run("{% set a = 'xxxxxxxxxxxxxxxx' %}{% for x in xs %}{% set a = a + a %}{% endfor %}", xs=range(40))


def test_conversations_of_any_id(spark):
    rows = [("b", 0, "user", "x"), ("a", None, "assistant", "y" * 300_000), (None, 1, "user", None), ("a", 2, "user", "z")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {"a": 2, "b": 1, None: 1} and got["a"]["loss_chars"] == 300_000
    odd = spark.createDataFrame([(float("nan"), 0, "user", "x"), (float("nan"), 1, "user", "y"), (1.5, 0, "user", "z")], "conv_id double, turn bigint, role string, text string")
    assert sorted(r["n_turns"] for r in chat.format_conversations(odd).collect()) == [1, 2]
    assert chat.format_conversations(odd.limit(0)).count() == 0


def test_every_license_sentence_and_rule_is_found(spark):
    """Each sentence in its own text, alone and wrapped in a comment, and each rule in a text of its sentences."""
    import textwrap

    s = licenses.SENTENCES
    wrapped = lambda x: textwrap.fill(x, 40, initial_indent="// ", subsequent_indent="// ")
    told = [(k, t) for k, x in s.items() for t in (x, wrapped(x), f"Some words first. {x}\n\nAnd after.")]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(told)], DOCS)).collect()
    assert {r["doc_id"]: r["sentence_ids"] for r in rows} == {i: [k] for i, (k, _) in enumerate(told)}
    ruled = licenses.scan(spark.createDataFrame([(i, "\n".join(s[k] for k in ids)) for i, (_, ids) in enumerate(licenses.RULES)], DOCS)).collect()
    assert {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in ruled} == {i: ([name], []) for i, (name, _) in enumerate(licenses.RULES)}


def test_weak_licenses(spark):
    s = licenses.SENTENCES
    bsd = "Copyright (c) 2020, A. " + "\n\n".join(s[k] for k in ("AllRights", "BsdRedistribution", "BsdSource", "BsdBinary", "BsdNeither"))
    docs = spark.createDataFrame([(1, bsd), (2, s["AllRights"]), (3, None), (4, f"{s['AllRights']} {s['BsdSource']}")], DOCS)
    weak = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.scan(docs, weak=licenses.WEAK).collect()}
    assert weak == {1: (["BSD-3-Clause"], []), 2: (["Proprietary"], []), 3: ([], []), 4: (["Proprietary"], ["BsdSource"])}
    assert licenses.scan(docs).where("doc_id = 1").first()["licenses"] == ["BSD-3-Clause", "Proprietary"]


def test_interleaved_licenses(spark):
    s = licenses.SENTENCES
    said = lambda *ids: "\n\n".join(s[k] for k in ids)
    cases = [
        (said("BsdRedistribution", "MitReleased", "BsdSource", "BsdBinary"), ["MIT"], ["BsdRedistribution", "BsdSource", "BsdBinary"]),
        (said("BsdRedistribution", "BsdSource", "BsdBinary", "BsdNeither", "MitReleased"), ["BSD-3-Clause", "MIT"], []),
        (said("MitReleased", "MitReleased"), ["MIT"], []),
        ("x " * 300_000 + ". " + said("AllRights"), ["Proprietary"], []),
        ("", [], []),
    ]
    docs = spark.createDataFrame([*((k, c[0]) for k, c in enumerate(cases)), (0, cases[0][0])], DOCS)
    got = licenses.scan(docs).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["licenses"], r["unmatched"]) == cases[r["doc_id"]][1:]
    assert licenses.scan(docs.limit(0)).count() == 0 and all(r["licenses"] == [] for r in licenses.scan(docs, rules=()).collect())


def test_digits_of_other_scripts():
    own = pii.Pseudonymiser(b"k")
    wide = lambda t, zero=0xFF10: "".join(chr(zero + int(c)) if c.isdigit() else c for c in t)
    for value in ("4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "2024-02-29", "97.51.17.173", "+1 (017) 555-7713"):
        new, kinds = own.text(f"a {value} b")
        assert kinds and value not in new
        for zero in (0xFF10, 0x0660, 0x1D7CE):
            out, also = own.text(f"a {wide(value, zero)} b")
            assert also == kinds and out == f"a {wide(new[2:-2], zero)} b" and own.text(out, back=True)[0] == f"a {wide(value, zero)} b"
    mixed = "\uff14111 1111 1111 1111"
    out, kinds = own.text(mixed)
    assert kinds == ["card"] and out[0] == wide(own.text("4111 1111 1111 1111")[0][0]) and own.text(out, back=True)[0] == mixed


def test_pseudonyms_edges(spark):
    docs = spark.createDataFrame([(1, ""), (None, "x@a.com " + "1 " * 200_000), (1, None), (1, "x@a.com")], DOCS).withColumn("pii_kinds", F.lit(1))
    got = pii.pseudonymise(docs, b"k").collect()
    assert sorted(len(r["pii_kinds"]) for r in got) == [0, 0, 1, 1] and pii.pseudonymise(docs.limit(0), b"k").count() == 0


def test_urls_ties_and_long(spark):
    rules = [("a.com", "/x", "block"), ("b.com", "/x", "allow"), ("com", "/xyz", "block")]
    long = "http://a.com/x" + "y" * 300_000
    rows = [(1, "http://a.com/xyz"), (2, "http://b.com/xyz"), (3, long), (4, None), (4, None)]
    got = {r["page_id"]: r["rule"] for r in urls.classify(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert got == {1: "a.com/x", 2: "b.com/x", 3: "a.com/x", 4: None}


def test_quality_rules_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 150_000), (2, None)], DOCS)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[1]["n_words"] == got[1]["n_repeat_words"] == 150_000 and got[1]["base_failed"] and quality_rules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_large_groups(spark, seed):
    """Near copies around the threshold, with and without their original, with frequent shingles dealt by class, against all pairs."""
    rng = random.Random(seed)
    rows, number = [], 0
    for own in (True, False):
        base = [f"b{rng.randrange(5000)}" for _ in range(120)]
        rows += [(number, " ".join(base))] * own
        for _ in range(70):
            number += 1
            words = [w if rng.random() > rng.choice((0.005, 0.015, 0.03)) else f"x{rng.randrange(10**6)}" for w in base]
            rows.append((number, " ".join(words[: rng.randrange(105, 121)])))
        number += 1
    was, jaccard.FREQUENT = jaccard.FREQUENT, 20
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        jaccard.FREQUENT = was
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 2


def test_jaccard_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:40_010])), (4, " ".join(words[40_000:]))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_shuffle(spark):
    """Passages that many unlike documents share are common; what is shuffled stays within 4 x the input."""
    rng = random.Random(7)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(8)) for _ in range(600)]
    rows = [(k, " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(50))) for k in range(2000)]
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    docs = spark.createDataFrame(rows, DOCS).repartition(2).localCheckpoint()
    got = jaccard.link(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k for k, _ in rows}
    now = stages()
    moved = sum(s.shuffleWriteBytes() for s in map(now.apply, range(now.size())) if (s.stageId(), s.attemptId()) not in before)
    size = sum(len(text) for _, text in rows)
    print("shuffled", moved / size)
    assert moved < 4 * size


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_jaccard_lists_lose_no_pair(size):
    """Lists cut by sizes and positions hold every pair that these allow, whatever the batches; entries alone go."""
    rng = np.random.default_rng(size)
    rows = sorted({(0, int(t), (int(n) << jaccard.PLACE) + int(n * p), k) for k, (t, n, p) in enumerate(zip(rng.integers(0, 12, 90), rng.integers(10, 60, 90), rng.random(90) / 5, strict=True))}, key=lambda r: (r[1], r[2], r[3]))
    rows = [r for r in rows for _ in range(1 + (r[3] % 3 == 0))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size]), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["salt", "token", "place", "key"]) for k in range(0, len(rows), size)]
    lists: dict[int, list] = {}
    for r in pa.Table.from_batches(list(jaccard._shared(iter(batches)))).to_pylist():
        lists.setdefault(r["token"], []).append((r["key"], r["lead"]))
    assert all(len(x) > 1 and len({k for k, _ in x}) == len(x) and {lead for _, lead in x} == {x[0][0]} for x in lists.values())
    together = {(a, b) for x in lists.values() for a, _ in x for b, _ in x}
    entry = {k: (t, p >> jaccard.PLACE, (p >> jaccard.PLACE) - (p & ((1 << jaccard.PLACE) - 1))) for _, t, p, k in rows}
    allowed = {(a, b) for a, (t, n, x) in entry.items() for b, (s, m, y) in entry.items() if a != b and t == s and 5 * min(n, m) >= 4 * max(n, m) and 9 * min(x, y) >= 4 * (n + m)}
    assert allowed and allowed <= together


def test_jaccard_half_of_the_ids(spark):
    """The other half tells classes whose first halves are equal; a key is that half of the id."""
    ids = [bytes([200] * 8 + [k] * 8) for k in (1, 255)]
    classes = spark.createDataFrame([(x,) for x in ids], "cid binary")
    assert jaccard._telling_half(classes) == 1 and jaccard._telling_half(classes.limit(1)) == 0
    assert [[r[0] for r in classes.select(jaccard._keys(h)).collect()] for h in (0, 1)] == [[jaccard._key(x, h) for x in ids] for h in (0, 1)]


def test_components_of_hubs_and_paths(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500), (340, 300)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark), "steps").collect())
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(300, 341), 300)}
