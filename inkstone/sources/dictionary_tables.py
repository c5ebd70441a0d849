"""Dictionaries as tables: lines become entries and problems, files and own specs are merged, all as DataFrames.

A line is a row (slot, mode, file, line, text): `file` numbers the files in the order in which they count, `line` the lines of
a file from 1, `mode` is append or override. The merge is an aggregate over (slot, key), so it has partial sums and no
window; only what a converter needs at the end, a few thousand pairs, goes to the driver (`collect_slots`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.sources.dictionaries import _BLANK, SLOTS

#: What is told of a line.
NO_TAB, EMPTY, UNKNOWN, REPEATED = "no tab", "empty key or value", "unknown slot", "replaced by a later line"


def read_lines(spark: SparkSession, files: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Lines of text files (slot, mode, path), whose order counts. A file is read whole, as its lines are numbered."""
    out = None
    for number, (slot, mode, path) in enumerate(files):
        whole = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
        one = whole.select(F.lit(slot).alias("slot"), F.lit(mode).alias("mode"), F.lit(number).alias("file"), F.posexplode("lines").alias("line", "text"))
        one = one.withColumn("line", F.col("line") + 1)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "slot string, mode string, file int, line int, text string")


def parse_lines(lines: DataFrame) -> DataFrame:
    """`lines` with key, value and problem; comments and blank lines are left out, lines with a problem have no key.

    Blanks and tabs at a line's ends go first, so a line that lacks a key or a value has no tab any more, but for blanks that
    aren't trimmed. The first candidate counts as the value; a byte order mark may open a file. A null text is a blank line.
    """
    raw = F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    rows = lines.withColumn("_d_line", F.btrim(raw, F.lit(_BLANK)))
    rows = rows.where((F.col("_d_line") != "") & ~F.col("_d_line").startswith("#") & ~F.col("_d_line").startswith("//"))
    tab = F.instr("_d_line", "\t")
    key = F.substring_index("_d_line", "\t", 1)
    value = F.regexp_extract("_d_line", r"(?s)^[^\t]*\t[ \t]*([^ \t]*)", 1)
    slot = F.lower(F.trim("slot"))
    problem = F.when(slot.isNull() | ~slot.isin(*SLOTS), UNKNOWN).when(tab == 0, NO_TAB).when((key == "") | (value == ""), EMPTY)
    good: Column = F.col("problem").isNull()
    rows = rows.withColumn("problem", problem).withColumn("slot", F.coalesce(slot, F.lit("")))
    return rows.withColumn("key", F.when(good, key)).withColumn("value", F.when(good, value)).drop("_d_line")


def merge_entries(parsed: DataFrame) -> DataFrame:
    """(slot, key, value, n_lines): the last line of each key, after the last file of its slot that overrides.

    An override replaces what stands in files before it, not in its own. `n_lines` counts the key's lines from there on.
    """
    good = parsed.where("problem IS NULL")
    # One row for each slot at most, of which there are as many as SLOTS has.
    since = parsed.where(F.col("problem").isNull() | (F.col("problem") != UNKNOWN)).groupBy("slot").agg(F.max(F.when(F.col("mode") == "override", F.col("file"))).alias("since"))
    kept = good.join(F.broadcast(since), "slot").where("since IS NULL OR file >= since")
    place = F.struct("file", "line", "value")
    return kept.groupBy("slot", "key").agg(F.max(place)["value"].alias("value"), F.count("*").alias("n_lines"))


def problems(parsed: DataFrame) -> DataFrame:
    """(slot, file, line, text, problem): lines that can't be read, and those that a later line of their own file replaces."""
    last = parsed.where("problem IS NULL").groupBy("slot", "file", "key").agg(F.max("line").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = parsed.where("problem IS NULL").join(last, ["slot", "file", "key"]).where("line < last").withColumn("problem", F.lit(REPEATED))
    columns = ["slot", "file", "line", "text", "problem"]
    return parsed.where("problem IS NOT NULL").select(columns).unionByName(again.select(columns))


def slot_bounds(entries: DataFrame) -> DataFrame:
    """(slot, n_entries, longest, shortest) with key lengths in UTF-16 units."""
    units = (F.octet_length(F.encode("key", "UTF-16BE")) / 2).cast("int")
    return entries.groupBy("slot").agg(F.count("*").alias("n_entries"), F.max(units).alias("longest"), F.min(units).alias("shortest"))


def collect_slots(entries: DataFrame) -> dict[str, dict[str, str]]:
    """The slots for the converters, which broadcast them: a dictionary is configuration, not data."""
    out: dict[str, dict[str, str]] = {}
    for row in entries.orderBy("slot", "key").select("slot", "key", "value").toLocalIterator():
        out.setdefault(row["slot"], {})[row["key"]] = row["value"]
    return out
