import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import sql
from inkstone.operators.convert import convert
from inkstone.sources.dictionaries import CustomSpec, apply_specs, bounds, example_slots, parse_text
from inkstone.sources.dictionary_tables import NO_TAB, REPEATED, UNKNOWN, collect_slots, merge_entries, parse_lines, problems, read_lines, slot_bounds

SCHEMA = "slot string, mode string, file int, line int, text string"


def test_lines_against_the_plain_parser(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a漢\U00020000\t\t  #/﻿　 \r") for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    rows = [("tw_phrases", "append", 0, k + 1, t) for k, t in enumerate(texts)]
    entries = merge_entries(parse_lines(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    wanted = parse_text(texts)
    assert collect_slots(entries) == {"tw_phrases": wanted} and len(wanted) > 100
    assert [(r["longest"], r["shortest"], r["n_entries"]) for r in slot_bounds(entries).collect()] == [(*bounds(wanted), len(wanted))]
    assert collect_slots(merge_entries(parse_lines(spark.createDataFrame([], SCHEMA)))) == {}


def test_files_in_order_against_specs(spark, tmp_path):
    """Appended and overriding files, by path, against the specs of the driver."""
    texts = {"a": "﻿甲\t1\n乙\t2\n甲\t3", "b": "# x\n丙\t4 5\n\n// y\n甲\t \t6", "c": "丁\t7\nno tab\n\t8\n戊\t", "d": "乙\t9\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, "utf-8")
    order = [("tw_phrases", "append", "a"), ("hk_phrases", "override", "a"), ("tw_phrases", "override", "b"), ("tw_phrases", "append", "c"), ("hk_phrases", "append", "d")]
    parsed = parse_lines(read_lines(spark, [(s, m, str(tmp_path / n)) for s, m, n in order]))
    wanted = apply_specs({}, [CustomSpec.from_file(s, tmp_path / n, m) for s, m, n in order])
    assert collect_slots(merge_entries(parsed)) == wanted and wanted["tw_phrases"] == {"丙": "4", "甲": "6", "丁": "7"}
    told = {(r["slot"], r["file"], r["line"], r["problem"]) for r in problems(parsed).collect()}
    assert told == {("tw_phrases", 0, 1, REPEATED), ("hk_phrases", 1, 1, REPEATED), ("tw_phrases", 3, 2, NO_TAB), ("tw_phrases", 3, 3, NO_TAB), ("tw_phrases", 3, 4, NO_TAB)}
    assert read_lines(spark, []).count() == 0


def test_slots_that_are_not_known(spark):
    rows = [("nope", "override", 1, 1, "a\tb"), (None, "append", 0, 1, "a\tb"), (" TW_Phrases ", "append", 0, 1, "a\tb"), ("tw_phrases", "append", 0, 2, None)]
    parsed = parse_lines(spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1)))
    assert collect_slots(merge_entries(parsed)) == {"tw_phrases": {"a": "b"}}
    assert [r["problem"] for r in problems(parsed).collect()] == [UNKNOWN] * 2


def test_conversion_by_name_in_sql(spark):
    slots = example_slots()
    sql.register(spark, slots)
    rows = [(k, t, c) for k, (t, c) in enumerate([("喫光標", "t2tw"), ("喫光標", " T2HKP"), (None, "t2tw"), ("喫", None), ("", "t2jp"), ("吃", "tw2t"), ("軟件", "t2twp")] * 50)]
    docs = spark.createDataFrame(rows, "k int, text string, config string").repartition(3)
    docs.createOrReplaceTempView("inkstone_mixed")
    got = {r["k"]: r["out"] for r in spark.sql("SELECT k, inkstone_convert(text, config) AS out FROM inkstone_mixed").collect()}
    wanted = {}
    for config in {c for _, _, c in rows if c}:
        one = docs.where(F.col("config") == config).select("k", convert(spark, F.col("text"), config.strip().lower(), slots).alias("out"))
        wanted |= {r["k"]: r["out"] for r in one.collect()}
    assert got == {k: wanted.get(k) for k in got} and len(got) == len(rows) and got[1] == "吃游標"
    with pytest.raises(Exception, match="no configuration with all its slots: 's2t'"):
        spark.sql("SELECT inkstone_convert('a', 's2t')").collect()


def test_pages_in_sql(spark):
    sql.register(spark, example_slots())
    rows = [(d, p, None if d == 2 else 3, None if p == 1 else "\U00020000x" * p) for d in (1, 2, 3) for p in (2, 0, 1)]
    spark.createDataFrame(rows, "doc bigint, page int, n_pages int, text string").repartition(4).createOrReplaceTempView("inkstone_some_pages")
    made = spark.sql("SELECT * FROM inkstone_pages(TABLE(inkstone_some_pages) PARTITION BY doc ORDER BY page)").collect()
    for d in (1, 2, 3):
        mine = sorted((r for r in made if r["doc"] == d), key=lambda r: r["position"])
        text = "".join(r["piece"] for r in mine)
        assert text == ("\n\n" + "\U00020000x" * 2 + "\n" if d == 2 else "=== [Page 1/3] ===\n\n\n\n=== [Page 2/3] ===\n\n\n\n=== [Page 3/3] ===\n\n" + "\U00020000x" * 2 + "\n\n")
        assert all(text[r["start"] :].startswith(r["piece"]) for r in mine)
    assert spark.sql("SELECT * FROM inkstone_pages(TABLE(SELECT * FROM inkstone_some_pages WHERE false) PARTITION BY doc ORDER BY page)").count() == 0
