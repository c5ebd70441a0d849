import pytest
from pyspark.sql import functions as F

from inkstone.functions import quotes, search
from inkstone.operators.convert import EMPTY_MESSAGE, convert, convert_text, normalise_compatibility, parse_compatibility, parse_custom_rare, parse_rare, replace_greedy, replace_rare, replacer, script_check, translate
from inkstone.plans.conversion import build_round, config_name, plan
from inkstone.sources.dictionaries import CustomSpec, apply_specs, bounds, example_slots, parse_text, read_bundle, write_bundle

SLOTS = example_slots()


def one(spark, column_of, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[1] for r in df.select("k", column_of(F.col("t")).alias("x")).orderBy("k").collect()]


def test_text_dictionary():
    lines = ["﻿甲\t乙 丙", "# no", "// no", "", "丁", "戊\t己", "戊\t庚"]
    assert parse_text(lines) == {"甲": "乙", "戊": "庚"}
    assert bounds({}) == (0, 0) and bounds({"𠀾": "x", "a": "b"}) == (2, 1)


def test_bundle_round_trip_and_old_form():
    assert read_bundle(write_bundle(SLOTS)) == SLOTS
    assert read_bundle('{"tw_variants": [{"a": "b"}, 1], "nope": [{}, 0], "hk_phrases": null}') == {"tw_variants": {"a": "b"}}
    with pytest.raises(ValueError):
        read_bundle('{"tw_variants": [{}, 1, 2]}')


def test_specs():
    spec = CustomSpec.parse("TW_Phrases : append:/a:b")
    assert spec == CustomSpec("tw_phrases", "append", ("/a:b",))
    for bad in ("tw_phrases", "nope:append:x", "tw_phrases:add:x", "tw_phrases:append: "):
        with pytest.raises(ValueError):
            CustomSpec.parse(bad)
    base = {"tw_phrases": {"a": "1", "b": "2"}}
    out = apply_specs(base, [CustomSpec.from_pairs("tw_phrases", {"a": "9"}), CustomSpec.from_pairs("hk_phrases", {"c": "3"}, "override")])
    assert out == {"tw_phrases": {"a": "9", "b": "2"}, "hk_phrases": {"c": "3"}} and base["tw_phrases"]["a"] == "1"


def test_rounds():
    assert config_name(" T2HKP ") == "t2hkp"
    with pytest.raises(ValueError):
        config_name("x2y")
    with pytest.raises(ValueError, match="st_characters"):
        plan("s2t", SLOTS)
    # A slot whose longest key has two units is no phrase slot: its two-character key is never looked up.
    assert build_round([{"ab": "x", "c": "y"}]).pairs == {"c": "y"}
    assert build_round([{"abc": "x", "c": "1"}, {"c": "2", "d": "3"}]).pairs == {"abc": "x", "c": "1", "d": "3"}
    # No key crosses a delimiter, but one may end a key.
    assert build_round([{"a,b": "x", "ab,": "y"}]).pairs == {"ab,": "y"}


def test_replacer_takes_the_longest():
    replace = replacer({"ab": "1", "abc": "2", "c": "3"})
    assert replace("abcabxcab") == "21x31" and replace("") == ""


def test_convert_cases(spark):
    for config, text, expected in (("t2hkp", "光標", "游標"), ("hk2tp", "游標", "光標"), ("t2tw", "喫茶小舖", "喫茶小舖"), ("t2tw", "喫", "吃"), ("t2hk", "無線新聞台", "無綫新聞台"), ("jp2t", "三国", "三國")):
        assert one(spark, lambda c: convert(spark, c, config, SLOTS), text, None, "") == [expected, None, ""]
    assert one(spark, lambda c: convert(spark, c, "t2tw", SLOTS, strict_empty=True), None, "", "喫") == [EMPTY_MESSAGE, EMPTY_MESSAGE, "吃"]


def test_script_and_rare(spark):
    st, ts = {"汉": "漢"}, {"漢": "汉"}
    assert one(spark, lambda c: script_check(c, st, ts), "abc漢", "汉!", "abc", None, "x" * 500 + "漢") == [1, 2, 0, 0, 0]
    entries = [("𠀾", "a", "B"), ("𫝆", "b", "D")]
    assert one(spark, lambda c: replace_rare(c, entries, "ExtC"), "𠀾𫝆", None) == ["𠀾b", ""]


def test_quotes(spark):
    assert one(spark, quotes.repair_quotes, "\"甲\"「\"'乙'", "don't 'x'", None, "") == ["“甲”「」‘乙’", "don't ‘x’", None, ""]
    assert one(spark, lambda c: quotes.repair_quotes(c, False), "don't") == ["don‘t"]
    issues = one(spark, quotes.quote_issues, "“ok”\n”no“\r\n「x”", None)
    assert [tuple(x) for x in issues[0]] == [(2, "”no“"), (3, "「x”")] and issues[1] == []


def test_search(spark):
    df = spark.createDataFrame([("a.b A.B",)], "t string")
    found = df.select(search.replace_all(F.col("t"), "a.b", "$1", match_case=False), search.replace_all(F.col("t"), "q", "x"), search.find_next(F.col("t"), "a", 1), search.utf16_length(F.lit("a𠀾"))).first()
    assert tuple(found[0]) == ("FOUND", "$1 $1", 2) and tuple(found[1]) == ("NO_MATCH", "a.b A.B", 0) and tuple(found[2]) == ("WRAPPED", 0) and found[3] == 3
    lines = spark.createDataFrame([("",), (" 2 ",), ("0",), ("-3",), ("x",), ("9",), ("99999999999",)], "v string").select(search.go_to_line(F.col("v"), F.lit(3)).alias("r")).collect()
    assert [r[0][0] for r in lines] == [False, True, False, False, False, False, False] and lines[5][0][2] == "Line must be between 1 and 3" and lines[6][0][2] == "Invalid line number"


def test_stream(spark, tmp_path):
    from inkstone.streaming.jobs import convert_stream

    rows = spark.createDataFrame([(1, "喫")], "k int, text string")
    rows.write.parquet(f"{tmp_path}/in")
    convert_stream(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/cp", "t2tw", SLOTS).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").collect()[0][1] == "吃"


def test_replace_greedy(spark):
    slots = [{"ab": "1", "c": "2", "。": "."}, {"ab": "9", "abc": "3", "a。b": "4", "abcd": "5"}]
    texts = ("abcab", "a。b", "c。。", "abcd", "", None)
    assert one(spark, lambda c: replace_greedy(spark, c, slots, 3), *texts) == ["31", "a.b", "2.。", "3d", "", None]


def test_values_of_any_length(spark):
    """No pair is dropped, whatever its lengths, and a value isn't replaced again."""
    pairs = {"a": "xy", "b": "z", "cd": "a", "q": ""}
    assert one(spark, lambda c: translate(c, pairs), "abcdq", "c", None) == ["xyza", "c", None]
    assert one(spark, lambda c: normalise_compatibility(c, pairs), "a", None) == ["xy", ""]
    assert one(spark, lambda c: translate(c, {"a": "a"}), "a") == ["a"]


def test_replacer_against_scan():
    """Against a scan of every place, with keys that overlap, are each other's parts, and stand at a text's end."""
    import random

    rng = random.Random(3)
    for _ in range(200):
        pairs = {"".join(rng.choices("abcd", k=rng.choice((1, 1, 2, 3, 4)))): "".join(rng.choices("abXY", k=rng.randrange(3))) for _ in range(rng.randrange(8))}
        text = "".join(rng.choices("abcde", k=40))
        out, at = "", 0
        while at < len(text):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(text) and text[at : at + n] in pairs), 0)
            out, at = out + (pairs[text[at : at + n]] if n else text[at]), at + max(n, 1)
        assert replacer(pairs)(text) == out


def test_chain_and_tables(spark):
    assert parse_compatibility(["# x", "", "\u8c48\t\u5c82"]) == {"\u8c48": "\u5c82"}
    assert parse_rare(["# x", "\U0002003e\ta\tExtB", "\U0002a700\tb\tc"]) == [("\U0002003e", "a", "B"), ("\U0002a700", "b", "C")]
    for f, bad in ((parse_compatibility, "ab\tc"), (parse_compatibility, "a"), (parse_rare, "a\tb"), (parse_rare, "a\tb\tZ")):
        with pytest.raises(ValueError, match="line 1"):
            f([bad])
    # Compatibility first, so that the conversion sees its result; rare ideographs last, so that they see the conversion's.
    slots = {"tw_variants": {"\u4e01": "\U0002003e"}, "tw_variants_phrases": {}}
    made = lambda c: convert_text(spark, c, "t2tw", slots, compatibility={"\uf900": "\u4e01"}, rare=[("\U0002003e", "z", "B")])
    assert one(spark, made, "\uf900\u4e01", None) == ["zz", ""]


def test_blanks_before_a_value():
    assert parse_text(["c\t d e", "f\t\tg", "h\t "]) == {"c": "d", "f": "g"}


def test_strict_and_own_tables(spark):
    """A compatibility table has exactly two sides; a table of one's own is filtered by level where it names extensions."""
    assert parse_compatibility([" \u8c48 \t \u5c82 ", "\u8c48\t\u66f4"]) == {"\u8c48": "\u66f4"}
    for bad in ("a\tb\tc", "a\t\tb", "ab\tc", "a"):
        with pytest.raises(ValueError, match="line 1"):
            parse_compatibility([bad])
        assert parse_compatibility([bad, "x\ty"], strict=False) == {"x": "y"}
    entries, pairs = parse_custom_rare(["# own", "", "\U0002003e\tb\tExtB", "\U0002b740\td\tD", "q\tr"])
    assert pairs == {"q": "r"}
    built_in = [("\U0002003e", "x", "B"), ("\U0002b740", "y", "D")]
    for level, expected in (("all", "bdr"), ("C", "\U0002003edr"), ("E", "\U0002003e\U0002b740r")):
        assert one(spark, lambda c: replace_rare(c, built_in + entries, level, pairs), "\U0002003e\U0002b740q") == [expected]
    with pytest.raises(ValueError):
        parse_custom_rare(["a\tb\tZ"])
