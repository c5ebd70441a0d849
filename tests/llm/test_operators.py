"""The operators on small tables, against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import chat, classifier, decontaminate, jaccard, licenses, packing, pii, quality_rules, toxicity, urls
from inkstone.llm.encode import Encoder

DOCS = "doc_id bigint, text string"


def text(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, text(rng, rng.randrange(30, 90), 4000)) for k in range(40)]
    rows += [(100 + k, rows[k % 6][1]) for k in range(20)]
    for k in range(40):
        words = rows[k % 8][1].split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((200 + k, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "A b C d E"), (905, "a b c d e"), (None, rows[0][1]), (0, rows[0][1])]


def shingles(t, n=5):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_jaccard_against_all_pairs(spark, corpus):
    got = {(r[0], r[1], r[2]) for r in jaccard.link(spark.createDataFrame(corpus, DOCS).withColumn("n", F.lit(1)).withColumn("cid", F.lit("x"))).select("doc_id", "n_shingles", "component_id").collect()}
    sets = [shingles(t) for _, t in corpus]
    parent = list(range(len(corpus)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(corpus)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    assert got == {(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(corpus)}
    assert jaccard.link(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_every_link(spark, corpus):
    """Links inside a group of near copies are all there, not only those that join it."""
    base = text(random.Random(6), 150, 4000).split()
    corpus = [*corpus, *((300 + k, " ".join([*base[: 20 * k], f"y{k}", *base[20 * k + 1 :]])) for k in range(6))]
    docs = spark.createDataFrame(corpus, DOCS)
    sets = [shingles(t) for _, t in corpus]
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    counts = jaccard.link_counts(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in counts) == sorted((str(i), sum(alike(sets[k], s) for j, s in enumerate(sets) if j != k)) for k, (i, _) in enumerate(corpus))
    name = {i: c for i, c, _ in counts}
    classes = {name[i]: sets[k] for k, (i, _) in enumerate(corpus) if sets[k]}
    every = sorted((a, b) for a in classes for b in classes if a < b and alike(classes[a], classes[b]))
    assert len(every) > len({x for pair in every for x in pair})
    assert sorted(map(tuple, jaccard.class_links(docs).collect())) == every


def test_keep_one_by_row(spark):
    """Ids that repeat with different texts lose no group, and near copies without ids are one."""
    rng = random.Random(12)
    a, b, c, d = (text(rng, 60, 4000) for _ in range(4))
    rows = [(0, a), (1, a), (1, b), (5, b), (1, c), (1, c), (None, d), (None, d + " x"), (None, None), (7, ""), (7, ""), (None, a)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, map(tuple, kept[:]))) in [sorted(map(str, [(0, a), (1, b), (1, c), (None, x), (None, None), (7, ""), (7, "")])) for x in (d, d + " x")]


def test_decontamination_against_scan(spark):
    rng = random.Random(7)
    items = [(k, text(rng, n, 30)) for k, n in enumerate((25, 12, 10, 4, 1, 0))] + [(6, None), (7, "W1, w2!")]
    docs = [(k, text(rng, 200, 30) + " " + items[k % 3][1]) for k in range(12)] + [(50, None), (51, ""), (52, "zz yy"), (52, "zz yy")]
    for options in ({}, {"block_bytes": 40}):
        found = decontaminate.find_matches(spark.createDataFrame(docs, DOCS).withColumn("spans", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string"), **options).collect()
        assert len(found) == len(docs)
        words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
        for r in found:
            w, hit, ids = words(r["text"]), set(), set()
            for i, t in items:
                v = words(t)
                n = min(10, len(v))
                for p in range(len(v) - n + 1) if n else ():
                    for q in range(len(w) - n + 1):
                        if w[q : q + n] == v[p : p + n]:
                            hit |= set(range(q, q + n))
                            ids.add(str(i))
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(ids))
    assert decontaminate.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id bigint, text string")).count() == len(docs)


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    encoder, rng = Encoder(path), random.Random(3)
    odd = ["".join(rng.choices(list("ab'strevm  \n\t!１²é　ß文й’\x1c_-"), k=rng.randrange(60))) for _ in range(400)] + ["<|endoftext|>", "don't I'll 'sx", "a" * 5000]
    assert all(x.tolist() == encoder.whole(t).tolist() for t, x in zip(odd, encoder.encode(pa.array(odd)), strict=True))
    docs = [(k, text(rng, rng.randrange(1, 900), 500)) for k in range(60)] + [(None, None), (7, ""), (7, "")]
    rows = packing.pack_documents(spark.createDataFrame(docs, DOCS).withColumn("length", F.lit("x")), path).toPandas()
    tokens = {k: [*encoder.whole(t or "").tolist(), 2] for k, t in docs[:60]}
    for k, own in rows[rows.doc_id < 60].groupby("doc_id"):
        if k == 7:
            continue
        own = own.sort_values("piece")
        assert np.concatenate(own.ids.to_list()).tolist() == tokens[k] and own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and (own.length[1:] == 1024).all()
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() <= 1024
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


@pytest.mark.parametrize("size", [8, 100, 1024])
def test_runs_are_best_fit_decreasing(size):
    """The packing from counts is the one of piece by piece: in the sequences' number and in what lies in each."""
    rng = np.random.default_rng(size)
    for n in (1, 2, 30, 700):
        lengths = rng.integers(1, (size if n % 2 else size // 2) + 1, n)
        sequence, _, total = packing.best_fit_decreasing(lengths, size)
        runs, found = packing.best_fit_runs(dict(zip(*np.unique(lengths, return_counts=True), strict=True)), size)
        assert found == total
        held = {}
        for length in np.unique(lengths):
            for rank in range(int((lengths == length).sum())):
                _, first_rank, first, each, offset = runs[(runs[:, 0] == length) & (runs[:, 1] <= rank)][-1]
                held.setdefault(first + (rank - first_rank) // each, []).append((offset + (rank - first_rank) % each * length, length))
        for own in held.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist() and sum(x for _, x in own) <= size
        contents = {}
        for k, x in zip(sequence.tolist(), lengths.tolist(), strict=True):
            contents.setdefault(k, []).append(x)
        assert sorted(sorted(x) for x in contents.values()) == sorted(sorted(int(x) for _, x in own) for own in held.values())


@pytest.mark.parametrize("parts", [1, 13])
def test_packing_of_the_whole_table(spark, parts):
    """As many sequences as one packing of all pieces needs, however they are dealt; ids of any size stay as they are."""
    rng = np.random.default_rng(parts)
    lengths = rng.integers(1, 1025, 40_000)
    ids = [None if k % 1000 == 7 else 2**53 + 1 + k for k in range(len(lengths))]
    table = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in zip(ids, lengths, strict=True)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(parts)
    rows = packing.pack(table).collect()
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == set(ids)
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id) == sorted((i, x) for i, x in zip(ids, lengths.tolist(), strict=True) if i)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(held) == packing.best_fit_decreasing(lengths, 1024)[2]
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist() and sum(x for _, x in own) <= 1024


def test_best_fit_is_tightest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    sequence, offset, n = packing.best_fit_decreasing(lengths, 100)
    free, most = [], 0
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, f in enumerate(free) if f >= size]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= size
        else:
            free.append(100 - size)
    assert n == len(free) and max(np.bincount(sequence, lengths)) <= 100


def test_pseudonyms(spark):
    t = 'a 4111 1111 1111 1111, 4111111111111111 4111111111111112 x.34@mail7.example.com 97.51.17.173 +1 (017) 555-7713 2024-02-29 30.02.2024 DE89 3704 0044 0532 0130 00 123-45-6789 key = "04dbebab91ab85687d33eeaa"'
    docs = spark.createDataFrame([(1, t), (2, None), (3, "x"), (1, t)], DOCS)
    done = pii.pseudonymise(docs, b"k")
    rows = {r["doc_id"]: r for r in done.collect()}
    out = rows[1]["text"]
    for raw in ("4111111111111111", "4111 1111 1111 1111", "x.34@", "97.51.17.173", "555-7713", "2024-02-29", "DE89", "123-45-6789", "04dbebab"):
        assert raw not in out
    assert "4111111111111112" in out and "30.02.2024" in out and rows[2]["text"] is None
    number = out[2:21].replace(" ", "")
    assert number in out.replace(out[2:21], "") and pii.luhn(number[:-1]) == int(number[-1])
    assert sorted(r["text"] or "" for r in pii.pseudonymise(done, b"k", back=True).collect()) == ["", t, t, "x"]
    p = pii.Permutation(b"k")
    assert sorted(p.apply(k, 1000, "t") for k in range(1000)) == list(range(1000))


def test_pseudonyms_with_neighbours():
    """Valid numbers are found with other numbers and words on both sides, and inverted."""
    own, rng = pii.Pseudonymiser(b"k"), random.Random(8)
    values = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "BE68539007547034"]
    for value in values:
        for after in ("", " 12/27", " 12 items", " BIC", " EUR 50", " 123", " 7 8 9", "-99", ", 12", " 2024-02-29", " ABCD 1234"):
            for before in ("", "12 ", "no 5, ", "EUR 50 ", "AB12 "):
                t = f"{before}{value}{after}"
                out, kinds = own.text(t)
                assert value not in out and {"card", "iban"} & set(kinds), t
                assert own.text(out, back=True)[0] == t, (t, out)
    for _ in range(500):
        body = "".join(rng.choices("0123456789", k=15))
        digits = body + str(pii.luhn(body))
        card = digits if rng.random() < 0.5 else " ".join(digits[k : k + 4] for k in range(0, 16, 4))
        t = f"{rng.choice(['', '12 ', '123 4567 ', '12-', '1 23-'])}{card}{rng.choice([' 12/27', ' 123', ' 12 34', ' 1', ' 5678 9'])}"
        out, _ = own.text(t)
        assert card not in out and own.text(out, back=True)[0] == t, (t, out)
    for t in ("12/31/2024", "02-29-2024", "12.25.1999"):
        out, kinds = own.text(t)
        assert kinds == ["date"] and out != t and int(out[3:5]) > 12 and own.text(out, back=True)[0] == t
    for t in ("13/31/2024", "02/30/2024", "4111 1111 1111 1112 12", "BE68 5390 0754 7035 EUR"):
        assert own.text(t) == (t, [])


def test_chat(spark):
    filters = {"escape": chat.escape}
    run = lambda s, **n: "".join(t for t, _ in chat.compile_template(s, filters)(**n))
    assert run("a{{ 1 + 2 }}{% if not true %}x{% elif n == 'q' %}y{% else %}z{% endif %}", n="q") == "a3y"
    assert run("{% for m in ms %}{{ loop.index }}{{ m.a | escape }}{% if not loop.last %},{% endif %}{% endfor %}{% set k = 'v' %}{{ k }}", ms=[{"a": "<s>"}, {"a": None}]) == "1<\\s>,2v"
    assert chat.fold(chat.parse("x{{ 'a' + 'b' }}{% if false %}n{% endif %}y"), {}) == [chat.Text("xaby")]
    for bad in ("{{ a.__class__() }}", "{% for x in %}", "{% if a %}", "{{ 'a }}", "{% endif %}", "{{ a | nope }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for t in ("</s>[INST] \\[INST] \\", "<|end|>\n<|turn|>", "\\<s>", ""):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    rows = [(1, 1, "assistant", "b<|end|>\n"), (1, 0, "user", "a\\"), (2, 0, None, None), (None, 3, "assistant", "x"), (1, 1, "assistant", "b<|end|>\n")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit(0))).collect()}
    import hashlib

    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\\\nassistant\nb<|end|>\n\nassistant\nb<|end|>\n\n").hexdigest()
    assert got[1]["loss_chars"] == 18 and got[1]["formatted_chars"] == len(got[1]["formatted"]) and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 0


def test_licenses(spark):
    known = "x. Released under the MIT License.\nLICENSED under CC by-nc 4.0.\nall rights reserved. Licensed under the Apache License, Version 2.0."
    rows = licenses.scan(spark.createDataFrame([(1, known), (2, None), (3, "mit license")], DOCS).withColumn("licenses", F.lit(1))).collect()
    assert rows[0]["licenses"] == ["Apache-2.0", "CC-BY-NC-4.0", "MIT", "Proprietary"] and rows[0]["unmatched"] == [] and rows[1]["licenses"] == rows[2]["sentence_ids"] == []
    part = licenses.scan(spark.createDataFrame([(1, licenses.SENTENCES["BsdSource"])], DOCS)).first()
    assert part["licenses"] == [] and part["unmatched"] == ["BsdSource"]


def test_licenses_wrapped(spark):
    """Hard-wrapped sentences, plain and in comments, and single lines between unpunctuated neighbours."""
    import textwrap

    s = licenses.SENTENCES
    gpl = [s["GplFree"], " ".join(s[k] for k in ("GplHope", "GplImplied", "GplSee"))]
    bsd = [s["BsdRedistribution"], "1. " + s["BsdSource"], "2. " + s["BsdBinary"]]
    mit = ["MIT License", "Copyright (c) 2020 A", s["MitPermission"], s["MitNotice"]]
    wrap = lambda parts, mark="", end="\n": f"{end}{mark}{end}".join(textwrap.fill(x, 60, initial_indent=mark, subsequent_indent=mark) for x in parts)
    cases = [
        (wrap(gpl), ["GPL-3.0-or-later"], 4),
        ("/*\r\n" + wrap(gpl, " * ").replace("\n", "\r\n") + "\r\n */", ["GPL-3.0-or-later"], 4),
        (wrap(gpl, "# "), ["GPL-3.0-or-later"], 4),
        (wrap(bsd, "// "), ["BSD-2-Clause"], 3),
        ("All rights reserved.\n" + "\n".join(textwrap.fill(x, 70) for x in bsd), ["BSD-2-Clause", "Proprietary"], 4),
        (wrap(mit), ["MIT"], 2),
        ("a title\nReleased under the MIT License\nanother line\nAll rights\nreserved", ["MIT", "Proprietary"], 2),
        ("Released under the\n\nMIT License", [], 0),
        ("Released under. the MIT License\nnot all rights reserved\nall rights reserved here", [], 0),
        ("x\n" * 50_000 + "\n" * 50_000 + " \n" * 50_000 + "Released under\nthe MIT License", ["MIT"], 1),
    ]
    rows = licenses.scan(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], DOCS)).collect()
    assert {r["doc_id"]: (r["licenses"], len(r["sentence_ids"]), r["unmatched"]) for r in rows} == {k: (c[1], c[2], []) for k, c in enumerate(cases)}


def test_urls(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x", "allow"), ("com", "", "block")]
    cases = {"http://b.A.org/x/y/z": "a.org/x/y", "http://a.org/x/q?a": "a.org/x", "http://a.org/w": "org/", "http://a.org": None, "ba.org/x": None, "http://ba.org/x": "org/", "http://c.com": None, "http://c.com/": "com", "s://a.org/x\U0010ffff": "a.org/x", "": None}
    rows = [(k, u) for k, u in enumerate(cases)] + [(99, None), (0, next(iter(cases)))]
    got = urls.classify(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit(1)), rules, salts=3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["rule"] == cases.get(r["url"]), r
    assert urls.classify(spark.createDataFrame([], "page_id bigint, url string"), rules).count() == 0


def test_quality_rules(spark):
    rng = random.Random(2)
    texts = [None, "", "a", text(rng, 60, 500), " ".join(["a b c d e f g h"] * 9), text(rng, 30, 500) + " \n" + " ".join(["the"] * 12), "x y\nx y\n\n \nz", text(rng, 40, 5)]
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_words", F.lit("clash"))).collect()
    for r in rows:
        w = (r["text"] or "").split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
        lines = [x for x in (r["text"] or "").split("\n") if x.strip()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["word_chars"]) == (len(w), len(again), len(lines) - len(set(lines)), len("".join(w)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        rows.append((k, text(rng, 60, 300) + (" idiot trash" if bad else " fine day")))
        labels.append((k, int(not bad), int(bad)))
    return rows + [(None, None), (n, ""), (0, rows[0][1])], labels


def test_classifiers(spark):
    rows, labels = labelled(random.Random(4), 500)
    docs, given = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for module, column in ((classifier, "quality"), (toxicity, "toxic")):
        got = [r for r in module.score(docs, given).collect()]
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        truth = {k: (q if column == "quality" else t) for k, q, t in labels}
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got if r["doc_id"] is not None)
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
        assert module.score(docs, given.limit(0)).count() == len(rows)
        assert module.score(docs.limit(0), given).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    body = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"word{rng.randrange(3000)}" for _ in range(4))]) for _ in range(n))
    item = body(30)
    texts = [body(80) for _ in range(20)]
    rows = [*enumerate(texts), (50, texts[3]), (51, texts[4] + " extra"), (52, body(40) + " " + item), (53, "###$$$ " * 40), (54, None), (55, body(60) + " 4111111111111111")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept == {*range(20), 55}
