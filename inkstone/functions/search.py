"""Find, replace and line navigation as column functions, with Java patterns inside Spark. Places are characters, not UTF-16 units."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F


def _pattern(find: str, match_case: bool, regex: bool) -> str:
    quoted = find if regex else "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return quoted if match_case else f"(?iu){quoted}"


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_all(column: Column, find: str, replacement: str, match_case: bool = True, regex: bool = False) -> Column:
    """struct<outcome, text, count>: FOUND with every match replaced, or NO_MATCH with the text as it is."""
    if not find:
        return F.struct(F.lit("NO_MATCH").alias("outcome"), column.alias("text"), F.lit(0).alias("count"))
    pattern = F.lit(_pattern(find, match_case, regex))
    n = F.regexp_count(column, pattern)
    done = F.regexp_replace(column, pattern, F.lit(replacement if regex else _literal(replacement)))
    return F.struct(F.when(n > 0, "FOUND").otherwise("NO_MATCH").alias("outcome"), F.when(n > 0, done).otherwise(column).alias("text"), F.coalesce(n, F.lit(0)).alias("count"))


def find_next(column: Column, find: str, caret: Column | int = 0, match_case: bool = True, regex: bool = False) -> Column:
    """struct<outcome, start>: the first match at or after `caret` (characters from 0), else, as WRAPPED, the first."""
    if not find:
        return F.struct(F.lit("NO_MATCH").alias("outcome"), F.lit(-1).alias("start"))
    found = find_match(column, find, caret, match_case=match_case, regex=regex)
    return F.struct(found["outcome"].alias("outcome"), found["start"].alias("start"))


#: Noncharacters that stand around matches while their places are counted; texts can't have them otherwise.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _sizes(column: Column, pattern: str) -> tuple[Column, Column]:
    """(characters before the first match of a scan, array<struct<n, gap>> of the matches: their own, and up to the next one)."""
    marked = F.regexp_replace(column, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    parts = F.split(marked, _OPEN, -1)
    match = lambda p: F.instr(p, _CLOSE) - 1
    sizes = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(match(p).alias("n"), (F.length(p) - match(p) - 1).alias("gap")))
    return F.length(F.element_at(parts, 1)), sizes


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


_NO_PLACES = "array<struct<start:int,end:int>>"


def matches(column: Column, find: str, match_case: bool = True, regex: bool = False) -> Column:
    """array<struct<start, end>> of all matches of a scan from the start, those of empty text too; characters from 0.

    U+FDD0 and U+FDD1, noncharacters that no text should have, mark the matches and don't count in places. Null has none."""
    first, sizes = _sizes(column, _pattern(find, match_case, regex))
    empty = F.from_json(F.lit("[]"), _NO_PLACES)

    def step(s: Column, x: Column) -> Column:
        here = F.struct(s["at"].alias("start"), (s["at"] + x["n"]).alias("end"))
        return F.struct((s["at"] + x["n"] + x["gap"]).alias("at"), F.concat(s["found"], F.array(here)).alias("found"))

    done = F.aggregate(sizes, F.struct(first.alias("at"), empty.alias("found")), step)["found"]
    return F.coalesce(done, empty)


def pattern_error(find: str, match_case: bool = True, regex: bool = False) -> str | None:
    """What is wrong with a pattern, as Java tells it; none if nothing is."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(_pattern(find, match_case, regex))
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def find_match(column: Column, find: str, caret: Column | int = 0, selection: tuple[Column, Column] | None = None, skip_empty: bool = False, backwards: bool = False, match_case: bool = True, regex: bool = False) -> Column:
    """struct<outcome, start, end, error> of the next match, or with `backwards` of the one before; characters from 0.

    It looks from the selection's end (its start, backwards), or from the caret if nothing is selected. FOUND is a match at or
    after that place, with the whole text seen by anchors and lookbehind; WRAPPED the first before it. Backwards, FOUND
    is the last match of a scan from the start that ends at or before it, and isn't empty there; WRAPPED the last of the text.
    `skip_empty` passes over an empty match at the place itself. NO_MATCH and INVALID_PATTERN (with the error) have -1. Null has
    no match."""

    def told(outcome: Column, start: Column, end: Column, error: str | None = None) -> Column:
        return F.struct(outcome.alias("outcome"), start.alias("start"), end.alias("end"), F.lit(error).cast("string").alias("error"))

    none = F.lit(-1)
    if not find:
        return told(F.lit("NO_MATCH"), none, none)
    if (error := pattern_error(find, match_case, regex)) is not None:
        return told(F.lit("INVALID_PATTERN"), none, none, error)
    at = F.lit(caret) if isinstance(caret, int) else caret
    if selection is not None:
        at = F.when(selection[0] != selection[1], selection[0 if backwards else 1]).otherwise(at)
    at = F.greatest(F.lit(0), F.least(at, F.length(column))).cast("int")
    first, sizes = _sizes(column, _pattern(find, match_case, regex))
    # What a scan has seen of the matches: the place goes through the state, as a column inside a lambda could be taken for a
    # new column of the same name. `near` is the last match before the place (forwards the first one), `last` the last of all.
    nothing = F.struct(none.alias("start"), none.alias("end"))

    def step(s: Column, x: Column) -> Column:
        here, end = s["at"], s["at"] + x["n"]
        empty = (here == s["place"]) & (end == s["place"])
        own = F.struct(here.alias("start"), end.alias("end"))
        counts = (end <= s["place"]) & ~empty if backwards else (s["near"]["start"] < 0) & (here < s["place"] + int(skip_empty)) & (~empty | F.lit(not skip_empty))
        last = F.when(empty, s["last"]).otherwise(own) if skip_empty else own
        return F.struct((end + x["gap"]).alias("at"), s["place"].alias("place"), F.when(counts, own).otherwise(s["near"]).alias("near"), last.alias("last"))

    seen = F.aggregate(sizes, F.struct(first.alias("at"), at.alias("place"), nothing.alias("near"), nothing.alias("last")), step, lambda s: F.struct(s["near"].alias("near"), s["last"].alias("last")))
    seen = F.coalesce(seen, F.struct(nothing.alias("near"), nothing.alias("last")))
    if backwards:
        chosen = lambda s: F.when(s["near"]["start"] >= 0, s["near"]).otherwise(s["last"])
        return _once(seen, lambda s: told(F.when(s["near"]["start"] >= 0, "FOUND").when(s["last"]["start"] >= 0, "WRAPPED").otherwise("NO_MATCH"), chosen(s)["start"], chosen(s)["end"]))
    since = at + 1 if skip_empty else at
    # All of the text up to a match, the least that begins at or after the place; groups keep their numbers.
    ahead = F.concat(F.lit(r"\A(?s:.{"), since.cast("string"), F.lit("}.*?)(?=" + _pattern(find, match_case, regex) + ")"))
    there = F.coalesce(F.call_function("regexp_like", column, ahead), F.lit(False)) & ((at < F.length(column)) | F.lit(not skip_empty))
    start = F.length(F.call_function("regexp_extract", column, ahead, F.lit(0)))
    through = F.concat(F.lit(r"\A(?s:.{"), start.cast("string"), F.lit("})(?:" + _pattern(find, match_case, regex) + ")"))
    end = F.length(F.call_function("regexp_extract", column, through, F.lit(0)))
    found = F.when(there, F.struct(F.lit("FOUND").alias("outcome"), start.alias("start"), end.alias("end")))
    wrapped = _once(seen, lambda s: F.struct(F.when(s["near"]["start"] >= 0, "WRAPPED").otherwise("NO_MATCH").alias("outcome"), s["near"]["start"].alias("start"), s["near"]["end"].alias("end")))
    return _once(F.coalesce(found, wrapped), lambda r: told(r["outcome"], r["start"], r["end"]))


def go_to_line(value: Column, lines: Column) -> Column:
    """struct<valid, paragraph_index, message> of a line number as text, for a text of so many lines."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    number = text.try_cast("bigint")
    most = F.greatest(F.lit(1), lines)
    message = (
        F.when(text == "", "Enter a line number")
        .when(text.rlike("^-[0-9]+$") | (text == "0"), "Line number must be positive")
        .when(~text.rlike("^[0-9]+$") | number.isNull() | (number > 2147483647), "Invalid line number")
        .when(number == 0, "Line number must be positive")
        .when(number > most, F.concat(F.lit("Line must be between 1 and "), most.cast("string")))
    )
    return F.struct(message.isNull().alias("valid"), F.when(message.isNull(), number - 1).otherwise(-1).cast("int").alias("paragraph_index"), message.alias("message"))


def utf16_length(column: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(column, "UTF-16BE")) / 2).cast("int")


def find_previous(column: Column, find: str, caret: Column | int, match_case: bool = True, regex: bool = False) -> Column:
    """struct<outcome, start>: the last match that ends at or before `caret`, else, as WRAPPED, the last of the text.

    Matches are those of a scan from the start; a pattern that also matches empty text isn't supported. Offsets are
    characters from 0. Null has no match."""
    none = F.struct(F.lit("NO_MATCH").alias("outcome"), F.lit(-1).alias("start"))
    if not find:
        return none
    pattern = F.lit(_pattern(find, match_case, regex))
    # The text between matches, and the matches, in turn: their lengths give each match its place.
    found = F.regexp_extract_all(column, pattern, F.lit(0))
    gaps = F.transform(F.split(column, pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    at = F.lit(caret) if isinstance(caret, int) else caret
    # The caret goes through the state: a column inside a lambda could be taken for a new column of the same name.
    start = F.struct(F.lit(0).alias("end"), F.lit(-1).alias("before"), F.lit(-1).alias("last"), at.alias("caret"))

    def step(s: Column, g: Column) -> Column:
        here, end = s["end"] + g["gap"], s["end"] + g["gap"] + g["n"]
        return F.struct(end.alias("end"), F.when(end <= s["caret"], here).otherwise(s["before"]).alias("before"), here.alias("last"), s["caret"].alias("caret"))

    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda a, b: F.struct(a.alias("gap"), b.alias("n")))
    done = F.aggregate(both, start, step)
    return F.struct(
        F.when(done["before"] >= 0, "FOUND").when(done["last"] >= 0, "WRAPPED").otherwise("NO_MATCH").alias("outcome"),
        F.when(done["before"] >= 0, done["before"]).when(done["last"] >= 0, done["last"]).otherwise(-1).alias("start"),
    )


def replace_current(column: Column, find: str, replacement: str, start: Column, end: Column, match_case: bool = True, regex: bool = False) -> Column:
    """struct<outcome, text, start, end>: FOUND with the selection replaced if it is exactly a match of a scan from the
    start, else NOT_COMPLETE_MATCH (NO_MATCH for nothing to find) with the text as it is and -1.

    The selection may have its ends the wrong way round and is cut to the text. Groups in the replacement are taken from
    the selection alone. A pattern that also matches empty text isn't supported. Null text has a null outcome."""
    if not find:
        return F.struct(F.lit("NO_MATCH").alias("outcome"), column.alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    pattern, cut = _pattern(find, match_case, regex), lambda x: F.greatest(F.lit(0), F.least(x, F.length(column)))
    low, high = cut(F.least(start, end)), cut(F.greatest(start, end))
    lengths = F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.slice(F.transform(F.split(column, F.lit(pattern), -1), F.length), F.lit(1), F.size(lengths))
    both = F.zip_with(gaps, lengths, lambda a, b: F.struct(a.alias("gap"), b.alias("n")))

    def step(s: Column, g: Column) -> Column:
        here, there = s["at"] + g["gap"], s["at"] + g["gap"] + g["n"]
        found = s["hit"] | ((here == s["low"]) & (there == s["high"]))
        return F.struct(there.alias("at"), found.alias("hit"), s["low"].alias("low"), s["high"].alias("high"))

    # The selection goes through the state, as the caret does above.
    hit = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), low.alias("low"), high.alias("high")), step)["hit"]
    chosen = F.substring(column, low + 1, high - low)
    put = F.regexp_replace(chosen, F.lit(f"^(?:{pattern})$"), F.lit(replacement)) if regex else F.lit(replacement)
    done = F.concat(F.substring(column, F.lit(1), low), put, F.substring(column, high + 1, F.length(column)))
    return F.struct(
        F.when(column.isNotNull(), F.when(hit, "FOUND").otherwise("NOT_COMPLETE_MATCH")).alias("outcome"),
        F.when(hit, done).otherwise(column).alias("text"),
        F.when(hit, low).otherwise(-1).alias("start"),
        F.when(hit, low + F.length(put)).otherwise(-1).alias("end"),
    )
