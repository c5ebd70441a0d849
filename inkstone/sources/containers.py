"""Text of DOCX, ODT and EPUB files: members of archives as rows, read by built-in functions and put together by file.

A member's markup is cut into tags and texts by a pattern; each becomes what it stands for (a text, a tab, a line end, the end
of a cell), and the pieces are joined. Package files of EPUB are read by `from_xml`, which also tells whether a
member is well formed. What can't be read gives a null text and an error, and the job goes on.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from inkstone.sources.archives import archive_members

#: A member that each format must have, and names of elements.
MEMBER = {"docx": "word/document.xml", "odt": "content.xml", "epub": "META-INF/container.xml"}
ODT_TYPE = "application/vnd.oasis.opendocument.text"
SILENT = ("script", "style", "head", "svg", "math", "noscript")
BLOCKS = ("p", "div", "section", "article", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "hr")
MAIN_PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")

#: Marks within texts that are being put together; texts don't have them, as they are noncharacters.
CELL, ROW, LAST = "﷐", "﷑", "﷒"
_PREFIX = r"(?:[\w.\-]+:)?"
_ATTRIBUTES = r"(?:\s[^>]*)?"


def content_text(content: Column) -> Column:
    """UTF-8 bytes as text without a byte order mark; bytes that aren't UTF-8 become replacement characters."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
    return F.translate(text, CELL + ROW + LAST, "")


def _character(digits: Column, base: int) -> Column:
    """The character of a code point's digits; null if there is none."""
    # Eight digits at most, which no code point needs more of.
    code = F.conv(F.right(digits, F.lit(8)), base, 10).cast("bigint")
    there = (F.length(F.ltrim(digits, F.lit("0"))) <= 8) & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(there, F.decode(F.unhex(F.lpad(F.hex(F.when(there, code)), 8, "0")), "UTF-32"))


def unescape(text: Column, names: dict[str, int] | None = None) -> Column:
    """`text` with references to characters, by number or by a name of `names`, resolved once; others stay."""
    known = F.create_map(*(F.lit(x) for n, k in (names or name2codepoint | {"apos": 39}).items() for x in (n, chr(k))))

    def one(x: Column) -> Column:
        number = F.when(x.startswith("&#x") | x.startswith("&#X"), _character(F.regexp_extract(x, "[0-9A-Fa-f]+(?=;)", 0), 16)).when(x.startswith("&#"), _character(F.regexp_extract(x, "[0-9]+", 0), 10))
        named = F.try_element_at(known, F.regexp_extract(x, r"^&(\w+);$", 1))
        return F.when(x.startswith("&") & (F.length(x) > 1), F.coalesce(number, named, x)).otherwise(x)

    parts = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|\w+);|[^&]+|&"), F.lit(0))
    return F.when(F.instr(text, "&") > 0, F.array_join(F.transform(parts, one), "")).otherwise(text)


def _plain_markup(xml: Column) -> Column:
    """Markup without comments, and with CDATA sections as escaped text."""
    out = F.regexp_replace(xml, "(?s)<!--.*?-->", "")
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = F.transform(F.split(out, r"(?=<!\[CDATA\[)|(?<=\]\]>)"), lambda x: F.when(x.startswith("<![CDATA["), escaped(F.regexp_replace(x, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1"))).otherwise(x))
    return F.when(F.instr(out, "<![CDATA[") > 0, F.array_join(parts, "")).otherwise(out)


def _rows_as_lines(text: Column) -> Column:
    """Cells of a row with tabs between them, without line ends at their own ends; also where rows are within cells."""
    out = F.replace(text, F.lit(CELL + ROW), F.lit(LAST))
    out = F.regexp_replace(out, f"[\r\n{LAST}{ROW}]*{CELL}", "\t")
    return F.regexp_replace(F.regexp_replace(out, f"[\r\n{LAST}{ROW}]*{LAST}", "\n"), ROW, "\n")


def _name(tag: Column) -> Column:
    """The local name of a tag, with a / before it where it ends an element."""
    return F.regexp_replace(F.regexp_extract(tag, rf"^<(/?{_PREFIX}[\w.\-]+)", 1), r"[\w.\-]+:", "")


def docx_text(xml: Column) -> Column:
    """Text of a part of a DOCX file: a line for each paragraph and each row of a table. Properties of paragraphs and runs
    aren't text; neither are notes that only separate."""
    out = F.regexp_replace(_plain_markup(xml), rf"(?s)<({_PREFIX}(?:pPr|rPr)){_ATTRIBUTES}(?<!/)>.*?</\1\s*>", "")
    apart = r'(?=[^>]*\btype\s*=\s*["\'](?i:separator|continuationSeparator|continuationNotice)["\']|[^>]*\bid\s*=\s*["\'](?:-\d+|0+)["\'])'
    out = F.regexp_replace(out, rf"(?s)<({_PREFIX}(?:footnote|endnote))\b{apart}[^>]*(?<!/)>.*?</\1\s*>", "")
    pattern = rf"<{_PREFIX}t{_ATTRIBUTES}(?<!/)>[^<]*|<{_PREFIX}(?:tab|br|cr){_ATTRIBUTES}/?>|</{_PREFIX}(?:p|tc|tr)\s*>|<{_PREFIX}(?:p|tc|tr){_ATTRIBUTES}/>"

    def piece(x: Column) -> Column:
        name = F.regexp_replace(_name(x), "^/", "")
        return (
            F.when(name == "t", F.regexp_replace(x, "^<[^>]*>", ""))
            .when(name == "tab", "\t").when(name.isin("br", "cr", "p"), "\n").when(name == "tc", CELL).otherwise(ROW)
        )

    pieces = F.transform(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)), piece)
    return _rows_as_lines(unescape(F.array_join(pieces, "")))


def odt_text(xml: Column) -> Column:
    """Text of `content.xml` of an ODT file."""
    between = rf"(</{_PREFIX}table-cell\s*>|</?{_PREFIX}table-row{_ATTRIBUTES}>|<{_PREFIX}table-cell{_ATTRIBUTES}/>)\s+(?=<)"
    out = F.regexp_replace(_plain_markup(xml), between, "$1")
    # The prolog isn't text.
    out = F.regexp_replace(out, r"^\s*(?:<[?!][^>]*>\s*)*", "")

    def piece(x: Column) -> Column:
        closed, name = x.endswith("/>"), _name(x)
        n = F.regexp_extract(x, r'\bc\s*=\s*["\']\s*(\d{1,6})\s*["\']', 1)
        ends = lambda *names: name.isin(*(f"/{n}" for n in names)) | (closed & name.isin(*names))
        return (
            F.when(~x.startswith("<"), x)
            .when(name == "tab", "\t").when(name == "line-break", "\n")
            .when(name == "s", F.repeat(F.lit(" "), F.greatest(F.lit(1), F.coalesce(F.when(n != "", n).cast("int"), F.lit(1)))))
            .when(ends("p", "h"), "\n").when(ends("table-cell"), CELL).when(ends("table-row"), ROW).otherwise("")
        )

    pieces = F.transform(F.regexp_extract_all(out, F.lit("<[^>]*>|[^<]+"), F.lit(0)), piece)
    return _rows_as_lines(unescape(F.array_join(pieces, "")))


def chapter_text(html: Column) -> Column:
    """Text of a chapter: blocks are paragraphs with an empty line between them, runs of blanks are one."""
    out = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), r"[ \t\r\n\x0B\f]+", " ")
    for name in SILENT:
        out = F.regexp_replace(out, rf"(?i)<{name}\b[^>]*(?<!/)>.*?</{name}\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>", "\x0b")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br(?:\s[^>]*)?/?>", "\f"), "<[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(unescape(out), "  +", " "), r" *\f *", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \n]*\x0B[ \n\x0B]*", "\n\n"), r"^[\n ]+", "")
    return F.translate(out, "\xa0\xad", " ")


def _kind() -> Column:
    """The kind of a file from all of its members: by the extension and the member that it must have."""
    ending = _ending()
    kind = F.coalesce(*(F.when((F.first(ending) == k) & F.bool_or(F.col("member") == m), k) for k, m in MEMBER.items()))
    # A type that the archive names itself must be the right one.
    named = F.max(F.when(F.col("member") == "mimetype", F.trim(F.col("content").cast("string"))))
    return F.when((kind == "odt") & (named != ODT_TYPE), None).otherwise(kind)


def _ending() -> Column:
    return F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))


def container_kinds(members: DataFrame) -> DataFrame:
    """(path, kind) of files from their members: docx, odt or epub, or null for any other."""
    return members.groupBy("path").agg(_kind().alias("kind"))


def _well_formed(xml: Column) -> Column:
    read = F.from_xml(xml, "there string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return read["broken"].isNull()


def _docx_rank() -> Column:
    """The place of a part in a DOCX file's text: main parts, headers, footers; null for any other member."""
    low = F.lower("member")
    beside = lambda k: low.startswith(f"word/{k}") & low.endswith(".xml")
    return reduce(lambda w, x: w.when(F.col("member") == x[1], x[0]), enumerate(MAIN_PARTS), F.when(F.lit(False), -1)).when(beside("header"), 4).when(beside("footer"), 5)


def _normal_path(path: Column) -> Column:
    """A path within an archive without `.` and `..`."""
    steps = F.split(path, "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", up(a)).otherwise(F.array_append(a, x))), "/")


_ROOTS = "rootfiles struct<rootfile array<struct<`_full-path` string>>>, broken string"
_PACKAGE = "manifest struct<item array<struct<_id string, _href string, `_media-type` string, _properties string>>>, spine struct<itemref array<struct<_idref string>>>, broken string"
_READ = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"}
#: Members that have no text.
_TEXTLESS = r"(?i)^(?!.*\.(?:jpe?g|png|gif|webp|svg|css|js|ttf|otf|woff2?|mp[34]|m4a|ogg|bin|emf|wmf|rels)$)"


def _spine(package: Column, folder: Column) -> Column:
    """The members of an EPUB file's spine in order, without navigation."""
    items = F.coalesce(package["manifest"]["item"], F.array())
    # The last of several items with an id.
    item = lambda ref: F.try_element_at(F.filter(items, lambda i: F.trim(i["_id"]) == F.trim(ref["_idref"])), F.lit(-1))
    text = lambda c: F.coalesce(c, F.lit(""))
    html = lambda i: F.contains(F.lower(text(i["_media-type"])), F.lit("html")) | F.lower(text(i["_href"])).rlike(r"\.(?:xhtml|html|htm)$")
    nav = lambda i: F.array_contains(F.split(F.lower(text(i["_properties"])), r"\s+"), "nav")
    name = lambda i: _normal_path(F.concat(F.when(i["_href"].startswith("/"), "").otherwise(folder), F.translate(text(i["_href"]), "\\", "/")))
    found = F.filter(F.transform(F.coalesce(package["spine"]["itemref"], F.array()), item), lambda i: i.isNotNull())
    return F.transform(F.filter(found, lambda i: html(i) & ~nav(i)), name)


def container_texts(files: DataFrame, headings: bool = False) -> DataFrame:
    """(path, kind, text, error) of each of `files` (path, content), whose paths differ; with `headings`, each part of a docx or
    epub is announced. A file of another kind has neither text nor error, unless its archive can't be opened.

    Members are unpacked once and read apart; one shuffle brings the texts of a file together in its row.
    """
    ending, xml = _ending(), content_text(F.col("content"))
    rank = F.when(ending == "docx", _docx_rank()).when((ending == "odt") & (F.col("member") == MEMBER["odt"]), 0)
    text = F.when(rank.isNotNull(), F.when(ending == "docx", docx_text(xml)).otherwise(odt_text(xml))).when(ending == "epub", chapter_text(xml))
    error = F.coalesce("error", F.when(rank.isNotNull() & ~_well_formed(xml), F.concat(F.lit("not well formed: "), "member")))
    is_root = (ending == "epub") & (F.col("member") == MEMBER["epub"])
    package = F.when((ending == "epub") & F.lower("member").rlike(r"\.(?:opf|xml)$"), F.from_xml(xml, _PACKAGE, _READ))
    read = archive_members(files.where(F.col("path").isNotNull()), _TEXTLESS).select(
        "path", "member", "ordinal", "error", F.when(F.col("member") == "mimetype", F.col("content")).alias("content"), rank.alias("rank"), text.alias("text"), error.alias("broken"),
        package.alias("package"), F.when(is_root, F.from_xml(xml, _ROOTS, _READ)["rootfiles"]["rootfile"]).alias("roots"),
    )
    part = F.struct("rank", F.lower("member").alias("low"), "ordinal", "member", "text", "broken", "package")
    whole = read.groupBy("path").agg(
        _kind().alias("kind"), F.max(F.when(F.col("member").isNull(), F.col("error"))).alias("closed"), F.array_sort(F.collect_list(F.when(F.col("member").isNotNull(), part))).alias("parts"), F.first("roots", ignorenulls=True).alias("roots")
    )
    # Each part of a docx once, whatever the case of its name.
    ranked = F.filter("parts", lambda p: p["rank"].isNotNull())
    once = F.filter(ranked, lambda p, k: (k == 0) | (p["low"] != F.coalesce(F.try_element_at(ranked, F.greatest(k, F.lit(1)))["low"], F.lit(""))))
    opf = F.trim(F.try_element_at(F.filter("roots", lambda r: F.trim(r["_full-path"]) != ""), F.lit(1))["_full-path"])
    named = lambda name: F.try_element_at(F.filter("parts", lambda p: p["member"] == name), F.lit(1))
    whole = whole.withColumn("opf", opf).withColumn("pack", F.when(F.col("opf").isNotNull(), named(F.col("opf")))["package"])
    chapters = F.filter(F.transform(_spine(F.col("pack"), F.regexp_extract("opf", "^(.*/)", 1)), named), lambda p: p.isNotNull())
    whole = whole.withColumn("read", F.when(F.col("kind") == "epub", chapters).otherwise(once))
    why = F.when(F.col("opf").isNull(), "no rootfile").when(F.col("pack").isNull(), "no package file").when(F.col("pack.broken").isNotNull(), "the package file isn't well formed")
    error = F.coalesce("closed", F.when(F.col("kind") == "epub", why), F.when(F.col("kind").isNotNull(), F.try_element_at(F.filter(F.transform("read", lambda p: p["broken"]), lambda e: e.isNotNull()), F.lit(1))))
    head = (lambda p: F.concat(F.lit("=== "), p["member"], F.lit(" ===\n"))) if headings else (lambda p: F.lit(""))
    ended = lambda p: F.concat(p["text"], F.when(p["text"].endswith("\n"), "").otherwise("\n"), F.when(F.col("kind") == "epub", "\n").otherwise(""))
    joined = F.array_join(F.transform("read", lambda p: F.when(F.col("kind") == "odt", p["text"]).otherwise(F.concat(head(p), ended(p)))), "")
    lines = F.replace(F.replace(joined, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.when(F.col("kind") == "epub", F.regexp_replace(lines, r"\n{3,}", "\n\n")).otherwise(lines)
    out = whole.withColumn("error", error).select("path", "kind", F.when(F.col("kind").isNotNull() & F.col("error").isNull(), lines).alias("text"), "error")
    nothing = files.where(F.col("path").isNull()).select(*(F.lit(None).cast("string").alias(c) for c in ("path", "kind", "text", "error")))
    return out.unionByName(nothing)


#: Names that people give to character sets.
CHARSETS = {"utf8": "UTF-8", "cp936": "GBK", "gb2312": "GBK", "cp950": "Big5"}


def charset(name: str | None) -> str:
    """The character set of a name in any case; UTF-8 for none."""
    name = (name or "").strip()
    return CHARSETS.get(name.lower(), name or "UTF-8")
