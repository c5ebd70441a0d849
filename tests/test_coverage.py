"""Dictionary folders and specs, places of matches, quote summaries, the second script check, the order of files."""

import re

import pytest
from pyspark.sql import functions as F

from inkstone.functions import quotes, search
from inkstone.operators.convert import EMPTY_MESSAGE, convert_once, script_check_converting
from inkstone.plans.conversion import config_or_default
from inkstone.sources import dictionaries as d
from inkstone.sources.documents import order_files


def test_folder_and_default(tmp_path):
    assert d.file_name("jps_characters_rev") == "JPShinjitaiCharactersRev.txt" and d.file_name("hk_variants_rev_phrases") == "HKVariantsRevPhrases.txt"
    for slot in d.SLOTS:
        if slot not in ("hk_phrases", "hk_phrases_rev", "ts_phrases"):
            (tmp_path / d.file_name(slot)).write_text(f"a\t{slot}\n", "utf-8")
    with pytest.raises(FileNotFoundError, match="ts_phrases"):
        d.load_folder(tmp_path)
    (tmp_path / "TSPhrases.txt").write_text("b\tc\n", "utf-8")
    slots = d.load_default(tmp_path)
    assert list(slots) == d.SLOTS and slots["hk_phrases"] == {} and slots["st_characters"] == {"a": "st_characters"}
    (tmp_path / d.BUNDLE).write_text(d.write_bundle({"st_characters": {"x": "y"}}), "utf-8")
    assert d.load_default(tmp_path) == d.load_default(tmp_path / d.BUNDLE) == {"st_characters": {"x": "y"}}
    assert d.load_default() == d.example_slots()


def test_specs(tmp_path):
    for k, text in enumerate(("a\t1\nb\t2\n", "b\t3\n")):
        (tmp_path / f"{k}.txt").write_text(text, "utf-8")
    spec = d.CustomSpec.from_files(" TW_Phrases", [tmp_path / "0.txt", tmp_path / "1.txt"], "override")
    assert d.apply_specs({"tw_phrases": {"c": "4"}}, [spec])["tw_phrases"] == {"a": "1", "b": "3"}
    assert d.CustomSpec.from_file("tw_phrases", tmp_path / "0.txt").mode == "append"
    for bad in (lambda: d.CustomSpec.from_files("tw_phrases", []), lambda: d.CustomSpec.from_file("tw_phrases", " "), lambda: d.CustomSpec("tw_phrases", "both", ("x",)), lambda: d.CustomSpec.from_pairs("x", {"a": "b"})):
        with pytest.raises(ValueError):
            bad()


PATTERNS = ["aa", "^", "$", "x*", r"\bb", "(?<=a)b", "(a)(b)?", "a|", r"(.)\1", "q"]
TEXTS = ["", "aaa", "ab ba", "xxaxx", "b\nab\n", "𠀾a𠀾aab", None]


def scan(pattern, text):
    return [m.span() for m in re.finditer(pattern, text)]


def test_find_match_against_scan(spark):
    rows = [(t, c) for t in TEXTS for c in (0, 1, 2, 4, 9)]
    df = spark.createDataFrame(rows, "t string, c int").coalesce(1)
    for p in PATTERNS:
        # Python's `$` and empty matches after others go by other rules than Java's, so these are told by hand below.
        if p == "$":
            continue
        for skip in (False, True):
            found = df.select("t", "c", search.find_match(F.col("t"), p, F.col("c"), skip_empty=skip, regex=True).alias("r")).collect()
            for t, c, r in found:
                if t is None:
                    assert tuple(r) == ("NO_MATCH", -1, -1, None)
                    continue
                at = min(c, len(t))
                m = re.compile(p).search(t, at + skip) if not (skip and at >= len(t)) else None
                # `search` from a place anchors ^ at the text's own start, as here.
                if m:
                    expected = ("FOUND", *m.span())
                else:
                    expected = next((("WRAPPED", a, b) for a, b in scan(p, t) if a < at + skip and not (skip and a == b == at)), ("NO_MATCH", -1, -1))
                assert tuple(r)[:3] == expected, (p, t, c, skip, r)


def test_find_backwards_and_errors(spark):
    df = spark.createDataFrame([("ab ab",)], "t string")
    ask = lambda **o: tuple(df.select(search.find_match(F.col("t"), regex=True, **o).alias("r")).first()[0])
    assert ask(find="ab", caret=4, backwards=True) == ("FOUND", 0, 2, None)
    assert ask(find="ab", caret=1, backwards=True) == ("WRAPPED", 3, 5, None)
    assert ask(find="ab", selection=(F.lit(3), F.lit(5)), backwards=True) == ("FOUND", 0, 2, None)
    assert ask(find="ab", selection=(F.lit(0), F.lit(2))) == ("FOUND", 3, 5, None)
    assert ask(find="$", caret=5, backwards=True) == ("WRAPPED", 5, 5, None)
    assert ask(find="$", caret=5, backwards=True, skip_empty=True) == ("NO_MATCH", -1, -1, None)
    bad = ask(find="(a")
    assert bad[:3] == ("INVALID_PATTERN", -1, -1) and bad[3]
    assert tuple(df.select(search.find_next(F.col("t"), "^b", 1, regex=True)).first()[0]) == ("NO_MATCH", -1)
    assert [tuple(x) for x in df.select(search.matches(F.col("t"), "b*", regex=True)).first()[0]] == [(0, 0), (1, 2), (2, 2), (3, 3), (4, 5), (5, 5)]


def test_summary(spark):
    df = spark.createDataFrame([("”x“\n”y“",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(quotes.summary(quotes.quote_issues(F.col("t")))).collect()]
    assert got[0].startswith("Found 2 suspicious") and got[1:] == [quotes.NO_ISSUES] * 2


def test_converting_check_and_default(spark):
    slots = {"st_characters": {"汉": "漢"}, "ts_characters": {"漢": "汉"}, "st_phrases": {"甲乙丙": "甲乙丁"}, "ts_phrases": {}, "st_punctuations": {}, "ts_punctuations": {}}
    df = spark.createDataFrame([("!漢",), ("a汉",), ("甲乙丙",), ("",), (None,), ("中" * 50 + "漢",), ("𠀾" * 25 + "漢",), ("x" * 600 + "漢",)], "t string")
    assert [r[0] for r in df.select(script_check_converting(spark, F.col("t"), slots)).collect()] == [1, 2, 2, 0, 0, 0, 0, 1]
    assert config_or_default(" T2S ") == "t2s" and config_or_default("x") == config_or_default(None) == "s2t"
    assert [r[0] for r in df.limit(4).select(convert_once(spark, F.col("t"), "nothing", slots)).collect()] == ["!漢", "a漢", "甲乙丁", EMPTY_MESSAGE]


def test_order_files(spark):
    rows = [("b.txt", 0), ("z.PDF", 1), ("a.txt", 2), ("a.pdf", 3), ("b.txt", 4), ("z.PDF", 5), (None, 6)]
    got = order_files(spark.createDataFrame(rows, "path string, added int")).orderBy("position").collect()
    assert [tuple(r) for r in got] == [("a.txt", 0), ("b.txt", 1), ("z.PDF", 2), ("a.pdf", 3)]
