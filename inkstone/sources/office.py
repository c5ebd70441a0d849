"""Conversion of Office and EPUB files in place: members of archives as rows, their markup converted as a column, and the members
of a file put back together by one aggregate.

What must stay (names of fonts, cells that aren't text) is cut out of a member before the conversion, with a mark in its place
that no key of a dictionary can match over, and put back after it. Other members keep their bytes; all keep their order.
Members whose names lead out of the archive are left out. A bad file gives a result that says so.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.operators.convert import convert
from inkstone.sources.archives import archive_members, pack_archives

#: Formats, and the attributes that name fonts.
FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")
_OPEN_DOCUMENT = ("style:font-name", "style:font-name-asian", "style:font-name-complex", "svg:font-family", "style:name")
FONT_ATTRIBUTES = {
    "docx": ("w:eastAsia", "w:ascii", "w:hAnsi", "w:cs"), "xlsx": ("val",), "pptx": ("typeface",),
    "odt": _OPEN_DOCUMENT, "ods": _OPEN_DOCUMENT, "odp": _OPEN_DOCUMENT,
}
#: Stands for what was cut out; a noncharacter, which texts don't have.
CUT = "﷐"


def _has_text(kind: Column, member: Column) -> Column:
    """Whether a member of a file of a kind is converted."""
    folder, name = F.regexp_extract(member, "^(.*/)?", 0), F.regexp_extract(member, "[^/]*$", 0)
    slide = F.startswith(name, F.lit("slide")) | reduce(lambda a, w: a | F.contains(name, F.lit(w)), ("notesSlide", "slideMaster", "slideLayout", "comment"), F.lit(False))
    xml = member.endswith(".xml")
    return (
        F.when(kind == "docx", member == "word/document.xml")
        .when(kind == "xlsx", (member == "xl/sharedStrings.xml") | (member.startswith("xl/worksheets/") & xml))
        .when(kind == "pptx", folder.startswith("ppt/") & slide & xml)
        .when(kind == "epub", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin("xhtml", "html", "opf", "ncx"))
        .otherwise(member == "content.xml")
    )


def _cut(kind: Column, member: Column, xml: Column, keep_fonts: bool) -> Column:
    """struct<text, kept>: the text to convert with marks in place of what is kept, and what is kept, in order."""
    xml = F.translate(xml, CUT, "")

    def by(pattern: str) -> Column:
        # Group 1 goes before what is kept.
        return F.struct(F.regexp_replace(xml, pattern, f"$1{CUT}").alias("text"), F.regexp_extract_all(xml, F.lit(pattern), F.lit(2)).alias("kept"))

    # Of a worksheet only what is between <is> and </is> is text, the rest is one piece each between them.
    cells = r"(?s)(?:^|(?<=</is>))()(.*?(?:<is>|<is\s[^>]*>|$))"
    out = F.when((kind == "xlsx") & member.startswith("xl/worksheets/"), by(cells))
    if keep_fonts:
        for k, names in FONT_ATTRIBUTES.items():
            out = out.when(kind == k, by(rf"((?<![\w:\-])(?:{'|'.join(names)})\s*=\s*[\"'])([^\"']*)"))
        out = out.when(kind == "epub", by(r"(font-family\s*:\s*)([^;\"'}<]*)"))
    return out.otherwise(F.struct(xml.alias("text"), F.array().cast("array<string>").alias("kept")))


def _put_back(text: Column, kept: Column) -> Column:
    pieces = F.split(text, CUT)
    return F.array_join(F.transform(pieces, lambda x, k: F.concat(x, F.when(k < F.size(kept), F.get(kept, k)).otherwise(""))), "")


def rewrite_office(spark: SparkSession, files: DataFrame, config: str, slots: Mapping[str, Mapping[str, str]], punctuation: bool = False, keep_fonts: bool = False) -> DataFrame:
    """(path, success, message, data) of `files` (path, kind, content), whose paths differ, converted by `config`."""
    known = F.lower("kind").isin(*FORMATS)
    chosen = files.where(known & F.col("path").isNotNull()).select("path", F.lower("kind").alias("kind"), "content")
    other = files.where(~(known & F.col("path").isNotNull()) | known.isNull()).select("path", F.lit(False).alias("success"), F.lit("the kind of the file isn't known").alias("message"), F.lit(None).cast("binary").alias("data"))
    # The kind goes with the path, so that members needn't be joined with their files.
    named = chosen.select(F.concat("kind", F.lit(":"), "path").alias("path"), "content")
    members = archive_members(named).withColumns({"kind": F.substring_index("path", ":", 1), "path": F.expr("substring(path, instr(path, ':') + 1)")})
    inside = F.aggregate(F.split(F.translate("member", "\\", "/"), "/"), F.lit(0), lambda d, x: F.when(d < 0, d).when(x.isin("", "."), d).when(x == "..", d - 1).otherwise(d + 1)) >= 0
    members = members.where(F.col("member").isNull() | (inside & ~F.startswith("member", F.lit("/"))))
    target = _has_text(F.col("kind"), F.col("member")) & F.col("error").isNull()
    xml = F.when(target, F.make_valid_utf8(F.col("content").cast("string")))
    cut = members.select("path", "kind", "ordinal", "member", "content", "error", F.inline(F.array(F.struct(target.alias("target"), _cut(F.col("kind"), F.col("member"), xml, keep_fonts).alias("cut")))))
    done = cut.withColumn("text", convert(spark, F.col("cut.text"), config, slots, punctuation))
    content = F.when(F.col("target"), F.encode(_put_back(F.col("text"), F.col("cut.kept")), "UTF-8")).otherwise(F.col("content"))
    first = (F.col("kind") == "epub") & (F.col("member") == "mimetype")
    row = F.when(F.col("member").isNotNull(), F.struct((~first).alias("later"), "ordinal", "member", content.alias("content")))
    whole = done.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("members"), F.sum(F.coalesce(F.col("target"), F.lit(False)).cast("int")).alias("n"), F.max("error").alias("error"), F.max("kind").alias("kind"), F.coalesce(F.bool_or(first), F.lit(False)).alias("typed"))
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("the archive can't be read: "), "error")).when((F.col("kind") == "epub") & ~F.col("typed"), "the archive has no member mimetype").when(F.col("n") == 0, "the archive has no member with text")
    told = whole.select("path", F.transform("members", lambda m: F.struct(m["member"].alias("member"), m["content"].alias("content"))).alias("members"), why.alias("why"), F.concat(F.col("n").cast("string"), F.lit(" member(s) converted")).alias("said"))
    # The message goes with the path through the packing, too.
    packed = pack_archives(told.where("why is null").select(F.concat("said", F.lit(":"), "path").alias("path"), "members"))
    good = packed.select(F.expr("substring(path, instr(path, ':') + 1)").alias("path"), F.lit(True).alias("success"), F.substring_index("path", ":", 1).alias("message"), F.col("content").alias("data"))
    bad = told.where("why is not null").select("path", F.lit(False).alias("success"), F.col("why").alias("message"), F.lit(None).cast("binary").alias("data"))
    return good.unionByName(bad).unionByName(other)
