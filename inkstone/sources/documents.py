"""Documents: page assembly, file sniffing, and text of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def assemble_pages(pages: Column, header: bool = False) -> Column:
    """The text of an ordered array of pages; with `header` each page is announced. Null pages are empty."""
    n = F.size(pages).cast("string")

    def one(page: Column, k: Column) -> Column:
        body = F.coalesce(page, F.lit(""))
        return F.concat(F.lit("=== [Page "), (k + 1).cast("string"), F.lit("/"), n, F.lit("] ===\n\n"), body, F.lit("\n\n")) if header else F.concat(body, F.lit("\n"))

    return F.array_join(F.transform(pages, one), "")


def order_files(files: DataFrame, path: str = "path", added: str = "added") -> DataFrame:
    """(path, position from 0) of a list of files, each once: PDF files last, in the order in which they were first
    added, before them the others by path in UTF-8 order. Rows without a path are left out.

    The positions are counted in a window over the whole list, which is a list that a user made."""
    pdf = F.col(path).rlike(r"(?i)\.pdf$")
    once = files.where(F.col(path).isNotNull()).groupBy(path).agg(F.min(added).alias("first"))
    order = (F.when(pdf, 1).otherwise(0), F.when(~pdf, F.col(path)), F.col("first"), F.col(path))
    return once.select(F.col(path).alias("path"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"))


def is_pdf(content: Column) -> Column:
    """Whether `%PDF-` stands in the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def is_binary(content: Column) -> Column:
    """Whether there is a NUL in the first 4096 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\x00") > 0


def sniff_text(content: Column) -> Column:
    """Text of UTF-8 bytes without a byte order mark; null if they are binary."""
    return F.when(~is_binary(content), F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""))


#: Elements whose text isn't read, and those that end a paragraph.
SILENT = ("script", "style", "head", "svg", "math", "noscript")
BLOCKS = "p div section article h1 h2 h3 h4 h5 h6 li tr blockquote br".split()


def html_text(html: Column) -> Column:
    """The text of a page, with built-in functions: silent elements dropped, blocks on lines of their own, soft
    hyphens dropped, no-break spaces plain, at most one empty line in a row. Null stays null."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for name in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    out = F.translate(out, " ­", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r]*\n[ \t\r]*", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))
