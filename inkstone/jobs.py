"""Jobs to run with spark-submit: `python -m inkstone.jobs convert|files|pages|dictgen ...`.

Inputs are folders that Spark reads, outputs are Parquet that it writes or, with --as-files, single files; only dictionaries
pass through the driver. Of errors in single files the rows tell, and the job goes on.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.functions.reflow import reflow_texts
from inkstone.operators.convert import LEVELS, convert, convert_text, parse_compatibility, parse_custom_rare, parse_rare
from inkstone.plans.conversion import config_name
from inkstone.sources.containers import charset
from inkstone.sources.dictionaries import SLOTS, CustomSpec, apply_specs, file_name, load_default, load_folder, write_bundle
from inkstone.sources.documents import assemble_pages, is_binary, is_pdf
from inkstone.sources.files import write_files
from inkstone.sources.office import FORMATS, rewrite_office

Slots = Mapping[str, Mapping[str, str]]
#: Character sets that Spark's own functions take; others go through an Arrow-batched function.
NATIVE = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def decode(content: Column, name: str | None) -> Column:
    """Text of bytes in a character set; bytes that it lacks become replacement characters. Null stays null."""
    known = charset(name)

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: bytes(c).decode(known, "replace"), na_action="ignore")

    return run(content)


def encode(text: Column, name: str | None) -> Column:
    """Bytes of text in a character set; what it lacks becomes a question mark. Null stays null."""
    known = charset(name)
    if known.upper() in NATIVE:
        return F.encode(text, known.upper())

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.encode(known, "replace"), na_action="ignore")

    return run(text)


def _converted_name(path: Column, config: str) -> Column:
    """`<base>_<config><extension>` of a path's last step."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"^(.*?)(\.[^.]*)?$", f"$1_{config_name(config)}$2")


def convert_files(spark: SparkSession, files: DataFrame, config: str, slots: Slots, punctuation: bool = False, keep_fonts: bool = False, in_charset: str | None = None, out_charset: str | None = None) -> DataFrame:
    """(path, name, success, message, data) of rows (path, content): Office and EPUB files rewritten, text files converted.

    `name` is `<base>_<config><extension>`. PDF files and other binary files are told as no success, with null data.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]{0,16})[^./]*$", 1))
    rows = files.select("path", "content", _converted_name(F.col("path"), config).alias("name"), kind.alias("kind"))
    # Of a file's path and its name only the path goes through the rewriting; the name is made of it again.
    office = rewrite_office(spark, rows.where(F.col("kind").isin(*FORMATS)), config, slots, punctuation, keep_fonts).withColumn("name", _converted_name(F.col("path"), config))
    wide = charset(in_charset).upper().startswith(("UTF-16", "UTF-32"))  # these have NULs in plain text
    told = F.when(is_pdf(F.col("content")) | (F.col("kind") == "pdf"), "PDF text isn't read").when(F.col("content").isNull() | (is_binary(F.col("content")) & F.lit(not wide)), "Not a text file")
    plain = rows.where(~F.col("kind").isin(*FORMATS)).withColumn("message", told)
    text = F.when(F.col("message").isNull(), F.regexp_replace(decode(F.col("content"), in_charset), "^﻿", ""))
    plain = plain.withColumn("data", encode(convert(spark, text, config, slots, punctuation), out_charset))
    return office.select("path", "name", "success", "message", "data").unionByName(plain.select("path", "name", F.col("message").isNull().alias("success"), "message", "data"))


def page_documents(spark: SparkSession, rows: DataFrame, config: str | None, slots: Slots, pages: str = "pages", punctuation: bool = False, header: bool = False, reflow: bool = False, compact: bool = False) -> DataFrame:
    """`rows` with `text` from an array of page texts: put together, reflowed and converted as asked; no config: as it is."""
    rows = rows.withColumn("text", assemble_pages(F.col(pages), header))
    if reflow:
        rows = reflow_texts(rows, "text", header, compact)
    return rows.withColumn("text", convert(spark, F.col("text"), config, slots, punctuation)) if config else rows


def _slots(args: argparse.Namespace) -> Slots:
    return apply_specs(load_default(args.dictionary), [CustomSpec.parse(s) for many in args.custom_dict for s in many.split(",")])


def _level(text: str) -> str:
    """A level of `replace_rare`, or a ValueError."""
    name = text.strip().upper()
    if name != "ALL" and name.removeprefix("EXT") not in tuple(LEVELS):
        raise ValueError(f"unknown level: {text!r}")
    return name


def _lines(path: str) -> list[str]:
    return Path(path).read_text("utf-8").split("\n")


def _chain(spark: SparkSession, text: Column, args: argparse.Namespace, slots: Slots) -> Column:
    """The conversion with what the options put before and after it."""
    compatibility = parse_compatibility(_lines(args.norm_compat)) if args.norm_compat else None
    if not args.detofu:
        return convert_text(spark, text, args.config, slots, args.punct, compatibility)
    rare = parse_rare(_lines(args.detofu_table)) if args.detofu_table else []
    more, own = parse_custom_rare(_lines(args.detofu_file)) if args.detofu_file else ([], None)
    return convert_text(spark, text, args.config, slots, args.punct, compatibility, rare + more, args.detofu, own)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="inkstone.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("convert", "files", "pages"):
        job = jobs.add_parser(name)
        job.add_argument("-i", "--input", required=True)
        job.add_argument("-o", "--output", required=True)
        job.add_argument("-c", "--config", type=config_name, required=name != "pages")
        job.add_argument("-p", "--punct", action="store_true")
        job.add_argument("-d", "--dictionary", help="JSON bundle or folder of text dictionaries; the example set without it")
        job.add_argument("-D", "--custom-dict", action="append", default=[], help="slot:append|override:path, repeated or with commas")
        job.add_argument("--in-enc")
        job.add_argument("--out-enc")
        if name != "pages":
            job.add_argument("--as-files", action="store_true", help="a file for each input, <base>_<config><extension>, instead of Parquet; what fails makes none")
        if name == "convert":
            job.add_argument("-n", "--norm-compat", metavar="TABLE", help="compatibility ideographs first, by this table")
            job.add_argument("--detofu", type=_level, metavar="LEVEL", help="rare ideographs of this extension (ExtB to ExtI) and later ones last, or all")
            job.add_argument("--detofu-table", metavar="TABLE", help="rare, fallback, extension")
            job.add_argument("--detofu-file", metavar="TABLE", help="a table that is put over the other: rare, fallback, extension, which count by the level; or pairs, which always count")
        if name == "files":
            job.add_argument("-k", "--keep-font", action="store_true")
        if name == "pages":
            job.add_argument("-H", "--header", action="store_true")
            job.add_argument("-r", "--reflow", action="store_true")
            job.add_argument("-C", "--compact", action="store_true")
            job.add_argument("-e", "--extract", action="store_true", help="no conversion")
    job = jobs.add_parser("dictgen")
    job.add_argument("-f", "--folder", required=True, help="text dictionaries with their usual names, or named <slot>.txt")
    job.add_argument("-o", "--output", required=True)
    job.add_argument("-c", "--compact", action="store_true")
    job.add_argument("-s", "--sort", action="store_true")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs one job. Wrong options end the program as argparse does."""
    parser = _parser()
    args = parser.parse_args(argv)
    if args.job == "dictgen":
        usual = {file_name(s) for s in SLOTS}
        found = sorted(Path(args.folder).glob("*.txt"))
        slots = load_folder(args.folder) if any(p.name in usual for p in found) else load_folder(args.folder, {p.stem: p.name for p in found})
        Path(args.output).write_text(write_bundle(slots, pretty=not args.compact, sort=args.sort or not args.compact), "utf-8")
        return
    if args.job == "convert" and not args.detofu and (args.detofu_table or args.detofu_file):
        parser.error("--detofu says from which extension on")
    if args.job == "pages" and not args.extract and not args.config:
        parser.error("a configuration is needed unless only extracting")
    spark, slots = spark or SparkSession.builder.appName("inkstone").getOrCreate(), _slots(args)
    if args.job == "pages":
        out = page_documents(spark, spark.read.parquet(args.input), None if args.extract else args.config, slots, punctuation=args.punct, header=args.header, reflow=args.reflow, compact=args.compact)
        out.write.parquet(args.output)
        return
    files = spark.read.format("binaryFile").load(args.input).select("path", "content")
    if args.job == "convert":
        text = _chain(spark, decode(F.col("content"), args.in_enc), args, slots)
        out = files.select("path", encode(text, args.out_enc).alias("data"))
        if args.as_files:
            out = out.withColumn("name", _converted_name(F.col("path"), args.config))
    else:
        out = convert_files(spark, files, args.config, slots, args.punct, args.keep_font, args.in_enc, args.out_enc)
    if args.as_files:
        write_files(out, args.output)
    else:
        out.write.parquet(args.output)


if __name__ == "__main__":
    main(sys.argv[1:])
