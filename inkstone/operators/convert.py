"""Text conversion as column functions: rounds of longest-match replacement, and code point maps.

All rounds of a configuration run in one Arrow function over a broadcast of their pairs, on the buffers of a whole batch (see
`matching`); text goes to Python and back once. Small maps of code points, which stand among other built-in functions, are
Spark's `translate`. No conversion shuffles; they run alike on streams.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from inkstone.operators.matching import matchers, replace_all
from inkstone.plans.conversion import DELIMITERS, config_or_default, plan
from inkstone.sources.dictionaries import units

#: What an empty input becomes where `strict_empty` is asked for.
EMPTY_MESSAGE = "Input text is null or empty"


def replacer(pairs: Mapping[str, str]) -> Callable[[str], str]:
    """A function that replaces, from left to right, the longest key at each place of one text; `Matcher` does it for many.

    Only first characters of keys of several characters are stopped at; what lies between matches of those has single code
    points to replace at most, and is translated in one go.
    """
    single = {ord(k): v for k, v in pairs.items() if len(k) == 1}
    by_first: dict[str, set[int]] = {}
    for key in pairs:
        if len(key) > 1:
            by_first.setdefault(key[0], set()).add(len(key))
    if not by_first:
        return lambda text: text.translate(single)
    sizes = {c: sorted(n, reverse=True) for c, n in by_first.items()}
    first = re.compile("[" + "".join(map(re.escape, sorted(sizes))) + "]")

    def replace(text: str) -> str:
        out, done = [], 0
        for m in first.finditer(text):
            at = m.start()
            if at < done:
                continue
            for n in sizes[text[at]]:
                value = pairs.get(text[at : at + n])
                if value is not None and at + n <= len(text):
                    out += (text[done:at].translate(single), value)
                    done = at + n
                    break
        return "".join(out) + text[done:].translate(single)

    return replace


def translate(column: Column, pairs: Mapping[str, str]) -> Column:
    """`column` with keys replaced: Spark's own `translate` where all are code points for code points, else by a `Matcher`."""
    pairs = {k: v for k, v in pairs.items() if k and not (len(k) == 1 and k == v)}
    if any(len(k) != 1 or len(v) != 1 for k, v in pairs.items()):
        return _matching([pairs], lambda: [pairs])(column)
    return F.translate(column, "".join(pairs), "".join(pairs.values())) if pairs else column


def _matching(rounds: list[Mapping[str, str]], shared: Callable[[], list[Mapping[str, str]]], lone: frozenset[str] = frozenset()):
    """All rounds one after another as an Arrow function; `shared` gives the rounds in a task."""
    key = hashlib.sha256(json.dumps([[list(r.items()) for r in rounds], sorted(lone)]).encode()).hexdigest()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return replace_all(texts, matchers(key, shared, lone))

    return run


def _broadcast(spark: SparkSession, rounds: list[Mapping[str, str]], lone: frozenset[str] = frozenset()):
    shared = spark.sparkContext.broadcast(rounds)
    return _matching(rounds, lambda: shared.value, lone)


def convert(spark: SparkSession, column: Column, config: str, slots: Mapping[str, Mapping[str, str]], punctuation: bool = False, strict_empty: bool = False) -> Column:
    """`column` in the script of `config`. Null stays null and empty stays empty, unless `strict_empty`."""
    rounds = [r.pairs for r in plan(config, slots, punctuation)]
    out = _broadcast(spark, rounds)(column) if rounds else column
    if strict_empty:
        out = F.when(column.isNull() | (column == ""), F.lit(EMPTY_MESSAGE)).otherwise(out)
    return out


def convert_once(spark: SparkSession, column: Column, config: str | None, slots: Mapping[str, Mapping[str, str]]) -> Column:
    """`column` in the script of `config`, or of the default configuration if there is none of that name; null and empty
    become a message."""
    return convert(spark, column, config_or_default(config), slots, strict_empty=True)


def replace_greedy(spark: SparkSession, column: Column, dictionaries: list[Mapping[str, str]], longest: int) -> Column:
    """The longest key of any dictionary at each place, the earlier dictionary's on a tie, without regard to slots.

    Keys of more than `longest` UTF-16 units don't count; no key matches over a delimiter, and a delimiter that follows
    another stays as it is. Null stays null."""
    pairs: dict[str, str] = {}
    for entries in dictionaries:
        for key, value in entries.items():
            if key and units(key) <= longest:
                pairs.setdefault(key, value)
    pairs = {k: v for k, v in pairs.items() if not DELIMITERS & set(k[:-1])}
    return _broadcast(spark, [pairs], DELIMITERS)(column)


def by_character(column: Column, pairs: Mapping[str, str]) -> Column:
    """Each code point alone by a character slot."""
    return translate(column, pairs)


#: What script detection passes over.
_PASSED_OVER = r"[!-/:-@\[-`{-~\t\n\x0B\f\r 0-9A-Za-z_著]"


def script_check(column: Column, st_characters: Mapping[str, str], ts_characters: Mapping[str, str]) -> Column:
    """1 for traditional, 2 for simplified, 0 for neither, by the first 100 characters that tell of the first 500
    UTF-16 units."""
    head = F.decode(F.substring(F.encode(F.substring(column, 1, 500), "UTF-16BE"), 1, 1000), "UTF-16BE")
    told = F.substring(F.regexp_replace(head, _PASSED_OVER, ""), 1, 100)
    return F.when(column.isNull() | (told == ""), 0).when(translate(told, ts_characters) != told, 1).when(translate(told, st_characters) != told, 2).otherwise(0)


def script_check_converting(spark: SparkSession, column: Column, slots: Mapping[str, Mapping[str, str]]) -> Column:
    """As `script_check`, but of the first 50 UTF-16 units that tell of the whole text, and by whole conversions, so that
    phrases count too. A character cut in two at the end counts as none."""
    told = F.regexp_replace(F.coalesce(column, F.lit("")), _PASSED_OVER, "")
    head = F.substring(told, 1, 50)
    # Characters that take two units move the cut forward.
    units_of = lambda c: F.when(c > "\uffff", 2).otherwise(1)
    parts = F.filter(F.split(head, ""), lambda c: c != "")
    kept = F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), lambda s, c: F.struct(F.when(s["n"] + units_of(c) <= 50, F.concat(s["text"], c)).otherwise(s["text"]).alias("text"), (s["n"] + units_of(c)).alias("n")))["text"]
    other = lambda config: convert(spark, kept, config, slots) != kept
    return F.when(kept == "", 0).when(other("t2s"), 1).when(other("s2t"), 2).otherwise(0)


#: Quotation marks of the simplified and the traditional script.
QUOTES = {"“": "「", "”": "」", "‘": "『", "’": "』"}


def convert_quotes(column: Column, config: str) -> Column:
    """Quotation marks to the traditional script's for configurations from `s…`, else to the simplified one's."""
    return translate(column, QUOTES if config.startswith("s") else {v: k for k, v in QUOTES.items()})


LEVELS = "BCDEFGHI"


def replace_rare(column: Column, entries: list[tuple[str, str, str]], level: str = "all", custom: Mapping[str, str] | None = None) -> Column:
    """Rare ideographs by their fallbacks. Entries are (rare, fallback, extension B to I); those of `level` and later
    extensions count, all of them for `all`. Custom pairs come over them at every level."""
    least = 0 if level.lower() == "all" else LEVELS.index(level.upper().removeprefix("EXT").strip())
    pairs = {rare: plain for rare, plain, ext in entries if LEVELS.index(ext.upper()) >= least}
    return translate(F.coalesce(column, F.lit("")), pairs | dict(custom or {}))


def normalise_compatibility(column: Column, pairs: Mapping[str, str]) -> Column:
    """Compatibility ideographs by their unified ones; null becomes empty."""
    return translate(F.coalesce(column, F.lit("")), pairs)


def convert_text(spark: SparkSession, column: Column, config: str, slots: Mapping[str, Mapping[str, str]], punctuation: bool = False, compatibility: Mapping[str, str] | None = None, rare: list[tuple[str, str, str]] | None = None, level: str = "all", custom_rare: Mapping[str, str] | None = None) -> Column:
    """The whole chain: compatibility ideographs first, if pairs for them are given, then the conversion, then rare ideographs."""
    out = normalise_compatibility(column, compatibility) if compatibility is not None else column
    out = convert(spark, out, config, slots, punctuation)
    return replace_rare(out, rare or [], level, custom_rare) if rare is not None or custom_rare is not None else out


def parse_compatibility(lines: Iterable[str], strict: bool = True) -> dict[str, str]:
    """Pairs of a compatibility table: code point, tab, code point, blanks around each aside; blank lines and those that begin
    with # are comments, and a later pair wins.

    Anything but two sides of one code point is an error that names the line, or is passed over unless `strict`."""
    out: dict[str, str] = {}
    for number, line in enumerate(lines, 1):
        bare = line.lstrip("\ufeff").strip(" \t\r\n")
        if not bare or bare.startswith("#"):
            continue
        sides = [x.strip() for x in bare.split("\t")]
        if list(map(len, sides)) == [1, 1]:
            out[sides[0]] = sides[1]
        elif strict:
            raise ValueError(f"line {number}: one code point, tab, one code point expected: {line!r}")
    return out


def parse_rare(lines: Iterable[str]) -> list[tuple[str, str, str]]:
    """Entries of a table of rare ideographs: rare, tab, fallback, tab, extension (B to I, or ExtB to ExtI)."""
    out = []
    for number, line in enumerate(lines, 1):
        parts = [x.strip() for x in line.lstrip("\ufeff").strip().split("\t")]
        if parts == [""] or parts[0].startswith("#"):
            continue
        ext = parts[2].upper().removeprefix("EXT").strip() if len(parts) > 2 else ""
        if len(parts) < 3 or not parts[0] or not parts[1] or len(ext) != 1 or ext not in LEVELS:
            raise ValueError(f"line {number}: rare, tab, fallback, tab, extension expected: {line!r}")
        out.append((parts[0], parts[1], ext))
    return out


def parse_custom_rare(lines: Iterable[str]) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """A user's own table of rare ideographs: entries of three columns as of `parse_rare`, which count by their extension,
    and pairs of two columns, which count at every level."""
    entries, pairs = [], {}
    for line in lines:
        parts = [x.strip() for x in line.lstrip("\ufeff").strip().split("\t")]
        if len(parts) == 2 and all(parts) and not parts[0].startswith("#"):
            pairs[parts[0]] = parts[1]
        else:
            entries.append(line)
    return parse_rare(entries), pairs
