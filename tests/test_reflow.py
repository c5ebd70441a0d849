import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstone.functions import search
from inkstone.functions.reflow import collapse, is_heading, is_metadata, reflow_lines, reflow_texts
from plain_reflow import reflow as plain
from inkstone.sources.office import rewrite_office


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        # Lines go together until a sentence has ended.
        ("他走進了房間看見桌上放著一封\n信，卻沒有人在。\n她站在窗前望著外面的雨點久久\n不語。", ["他走進了房間看見桌上放著一封信，卻沒有人在。", "她站在窗前望著外面的雨點久久不語。"]),
        # An empty line inside a sentence is soft.
        ("他走進了房間看見桌上放著一封\n\n信，卻沒有人在。", ["他走進了房間看見桌上放著一封信，卻沒有人在。"]),
        # Titles, page marks, dividers and bibliographic data stand alone.
        ("第一章 風起\n=== [Page 1/2] ===\n作者：某人\n──────\n前言", ["第一章 風起", "=== [Page 1/2] ===", "作者：某人", "──────", "前言"]),
        # A dialog that is open goes on over lines; a whole one stands alone.
        ("「你去了什麼地方呢我找了你\n很久。」\n「是嗎？」\n她點了點頭然後又看著遠方的山\n坡。", ["「你去了什麼地方呢我找了你很久。」", "「是嗎？」", "她點了點頭然後又看著遠方的山坡。"]),
        # An open bracket holds a paragraph together.
        ("這是一段帶有括號（其中的話很長\n\n還沒有說完）的文字而且繼續。", ["這是一段帶有括號（其中的話很長還沒有說完）的文字而且繼續。"]),
        ("1、先把水燒開。\n2、再把茶葉放進去。", ["1、先把水燒開。", "2、再把茶葉放進去。"]),
        # A comma before keeps a short line from being a heading; a full stop allows it.
        ("他回頭看了看身後的那一條路，\n沒有人\n於是走了。", ["他回頭看了看身後的那一條路，沒有人於是走了。"]),
        ("他走了。\n雨夜\n天黑了，路上已經沒有什麼行人了。", ["他走了。", "雨夜", "天黑了，路上已經沒有什麼行人了。"]),
        # An indent begins a paragraph.
        ("這一行的文字沒有任何標點符號\n　　下一行是有縮進的另外一個段落", ["這一行的文字沒有任何標點符號", "　　下一行是有縮進的另外一個段落"]),
    ],
)
def test_reflow(spark, lines, expected):
    texts = [(1, lines), (2, lines.replace("\n", "\r\n"))]
    df = spark.createDataFrame(texts, "k int, text string")
    assert [r.text for r in reflow_texts(df).collect()] == ["\n\n".join(expected)] * 2
    assert [r.text for r in reflow_texts(df, compact=True).collect()] == ["\n".join(expected)] * 2


def test_reflow_of_blank_and_long_texts(spark):
    long = "\n".join(["word after word without an end, and so on,"] * 20000)
    df = spark.createDataFrame([("",), (" \n\t\n ",), (None,), (long,)], "text string")
    assert sorted((r.text for r in reflow_texts(df).collect()), key=lambda t: (t is not None, t)) == [None, "", "", long.replace("\n", "")]
    df = spark.createDataFrame([("甲乙丙丁戊己庚辛壬癸，\n\n子丑",)], "text string")
    assert reflow_texts(df, page_headers=True).first().text == "甲乙丙丁戊己庚辛壬癸，\n\n子丑"


def column(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(f(F.col("t"))).collect()]


def test_collapse_and_kinds_of_lines(spark):
    cases = {"甲乙 甲乙 甲乙  丙": "甲乙 丙", "a b a b a b": "a b", "a a b": "a a b", "x a b a b a b a b c a a a": "x a b c a a a", "abcdabcdabcd": "abcd", "哈哈哈哈哈哈": "哈哈哈哈哈哈", "": "", "a a a a": "a"}
    assert column(spark, collapse, *cases) == list(cases.values())
    assert column(spark, is_metadata, "書名：某書", "ISBN: 123", "前言：「他說」", "他說：好", "作者：") == [True, True, False, False, False]
    kinds = {"2024": True, "Part One": True, "楔子之前": True, "走了，": False, "他走了。": False, "（完": False, "物品準備：": True, "【作者的話】": True}
    assert column(spark, is_heading, *kinds) == list(kinds.values())


def random_text(r):
    """Lines of pieces that the rules look at, cut anywhere."""
    pieces = ["他走進了房間", "信", "，", "。", "！", "：", "…", "..", "「", "」", "『", "』", "“", "”", "（", "）", "(", ")", "【", "】", "《", "》", "<", "a", "word ", "Part 2", "12", "第一章 ", "第三回的", "卷二", "前言", "目录", "作者：", "ISBN: 1", "1、", "2) ", "（三）", "• ", "3.漢", "───", "* * *", "=== [Page 1/2] ===", " ", "\t", "\u3000\u3000", "甲乙 甲乙 甲乙", "abcdabcdabcd", "雨夜", "章", "回」", "、", ",", "﹁", "﹂", "沒有任何標點符號的一行文字" * 3]
    return "".join(r.choice(pieces) if r.random() < 0.72 else r.choice(["\n", "\n", "\n\n", "\r\n", "\r"]) for _ in range(r.randrange(1, 60)))


@pytest.mark.parametrize("headers", [False, True])
def test_against_the_plain_rules(spark, headers):
    import random

    r = random.Random(11 + headers)
    texts = [random_text(r) for _ in range(1500)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, first string").repartition(3)
    for row in reflow_texts(df, page_headers=headers, compact=True).collect():
        assert row.text == plain(texts[row.k], headers, True), texts[row.k]
        assert row.first == "x"


def test_lines_of_documents(spark):
    import random
    import re

    r = random.Random(5)
    texts = [random_text(r) for _ in range(60)]
    lines = [(d, k, t) for d, text in enumerate(texts) for k, t in enumerate(re.split("\r\n|\r|\n", text))]
    r.shuffle(lines)
    rows = reflow_lines(spark.createDataFrame(lines, "doc int, line int, text string").repartition(7)).collect()
    for d, text in enumerate(texts):
        got = [x.text for x in sorted(rows, key=lambda x: (x.doc, x.paragraph)) if x.doc == d]
        assert "\n".join(got) == plain(text, compact=True)


def test_replace_current(spark):
    df = spark.createDataFrame([("a the the", 6, 9), ("a the the", 9, 6), ("a the the", 5, 9), ("", 0, 3), (None, 0, 1)], "t string, a int, b int")
    rows = df.select(search.replace_current(F.col("t"), "the", "$1", F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r[0]) for r in rows] == [("FOUND", "a the $1", 6, 8), ("FOUND", "a the $1", 6, 8), ("NOT_COMPLETE_MATCH", "a the the", -1, -1), ("NOT_COMPLETE_MATCH", "", -1, -1), (None, None, -1, -1)]
    one = df.limit(1).select(search.replace_current(F.col("t"), "t(h)E", "<$1>", F.lit(2), F.lit(5), match_case=False, regex=True).alias("r")).first()[0]
    assert tuple(one) == ("FOUND", "a <h> the", 2, 5)


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in members.items():
            file.writestr(name, text)
    return out.getvalue()


def members(data):
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        return {i.filename: file.read(i).decode() for i in file.infolist()}, [i.compress_type for i in file.infolist()]


SLOTS = {"tw_variants": {"喫": "吃"}, "tw_variants_phrases": {}}


def rewritten(spark, *files, **more):
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "k int, kind string, content binary").select(F.concat(F.lit("a:/b/"), F.col("k").cast("string")).alias("path"), "kind", "content")
    rows = {r.path: r for r in rewrite_office(spark, df, "t2tw", SLOTS, **more).collect()}
    assert len(rows) == len(files)
    return [rows[f"a:/b/{k}"] for k in range(len(files))]


def test_rewrite_office(spark):
    doc = packed({"word/document.xml": '<w w:ascii="喫" w:x="喫">喫</w>', "word/other.xml": "喫", "../out": "x", "/abs": "x", "a/../../b": "x"})
    (kept,), (plain_,) = rewritten(spark, ("docx", doc), keep_fonts=True), rewritten(spark, ("DOCX", doc))
    assert kept.success and kept.message == "1 member(s) converted" and members(kept.data)[0] == {"word/document.xml": '<w w:ascii="喫" w:x="吃">吃</w>', "word/other.xml": "喫"}
    assert members(plain_.data)[0]["word/document.xml"] == '<w w:ascii="吃" w:x="吃">吃</w>'
    sheet = '<c t="inlineStr"><is><t>喫</t></is></c><c t="s"><v>喫</v></c><c t="inlineStr"><is><t></t></is></c><c><is ><t>a喫</t></is></c>喫'
    slides = {"ppt/slides/slide1.xml": "喫", "ppt/notesSlides/notesSlide1.xml": "喫", "ppt/theme/theme1.xml": "喫", "x/slide1.xml": "喫"}
    book = {"a.XHTML": "<p style=\"font-family: 喫;\">喫</p>", "mimetype": "application/epub+zip", "b.css": "喫"}
    odt = {"content.xml": '<s style:font-name="喫" x:style:name="喫">喫</s>', "styles.xml": "喫"}
    got = rewritten(spark, ("xlsx", packed({"xl/worksheets/a.xml": sheet, "xl/sharedStrings.xml": "喫"})), ("pptx", packed(slides)), ("epub", packed(book)), ("ods", packed(odt)), keep_fonts=True)
    assert members(got[0].data)[0] == {"xl/worksheets/a.xml": sheet.replace("<t>喫", "<t>吃").replace("a喫", "a吃"), "xl/sharedStrings.xml": "吃"}
    assert list(members(got[1].data)[0].values()) == ["吃", "吃", "喫", "喫"]
    made, kinds = members(got[2].data)
    assert list(made.items()) == [("mimetype", "application/epub+zip"), ("a.XHTML", "<p style=\"font-family: 喫;\">吃</p>"), ("b.css", "喫")] and kinds[0] == zipfile.ZIP_STORED
    assert members(got[3].data)[0] == {"content.xml": '<s style:font-name="喫" x:style:name="吃">吃</s>', "styles.xml": "喫"}


def test_rewrite_of_bad_files(spark):
    got = rewritten(spark, ("docx", b"no"), ("docx", packed({"x": "y"})), ("epub", packed({"a.html": "y"})), ("pdf", packed({"x": "y"})), ("odt", None), (None, b""), ("odt", packed({"content.xml": "<p>喫</p>"})))
    assert [r.success for r in got] == [False] * 6 + [True] and all(r.data is None and r.message for r in got[:6])
    assert members(got[6].data)[0]["content.xml"] == "<p>吃</p>"
