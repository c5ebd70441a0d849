"""Dialog quotation marks: repair and validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Opening marks with their closing ones, curly and corner, of the outer and the inner level.
OUTER = {"“": "”", "「": "」"}
INNER = {"‘": "’", "『": "』"}
OPENERS, CLOSERS = "“‘「『", "”’」』"


#: Marks that one step of the outer fold takes.
RUN = 256


def repair_quotes(column: Column, keep_apostrophes: bool = True) -> Column:
    """Texts with plain quotation marks turned into the marks of the dialog that they belong to. Null stays null.

    A level's state is the closing mark that is due, or none: an opening mark makes its partner due, a closing one clears
    it, and a plain one is the one due, or else a curly opening mark. Both levels are one fold over the marks of a
    text, in runs of a bounded size; what lies between the marks isn't touched. Single marks between ASCII letters stay, and
    change nothing, if `keep_apostrophes`.
    """
    passed = r"(?<![A-Za-z])['‘’]|['‘’](?![A-Za-z])" if keep_apostrophes else "['‘’]"
    mark = rf"[\"“”「」『』]|{passed}"
    marks, gaps = F.regexp_extract_all(column, F.lit(mark), F.lit(0)), F.split(column, mark)
    partner = F.create_map(*(F.lit(x) for pair in (OUTER | INNER).items() for x in pair))
    curly = {"\"": next(iter(OUTER)), "'": next(iter(INNER))}

    def step(s: Column, m: Column) -> Column:
        due = F.when(m == "\"", s["outer"]).otherwise(s["inner"])
        plain = m.isin(*curly)
        said = F.when(plain & (due != ""), due).when(m == "\"", curly["\""]).when(m == "'", curly["'"]).otherwise(m)
        opens = F.contains(F.lit(OPENERS), said)
        after = F.when(opens, F.try_element_at(partner, said)).otherwise("")
        is_outer = F.contains(F.lit("".join(OUTER) + "".join(OUTER.values())), said)
        return F.struct(
            F.when(is_outer, after).otherwise(s["outer"]).alias("outer"), F.when(is_outer, s["inner"]).otherwise(after).alias("inner"), F.concat(s["out"], said).alias("out")
        )

    empty = F.struct(F.lit("").alias("outer"), F.lit("").alias("inner"), F.lit("").alias("out"))
    again = lambda s: F.struct(s["outer"].alias("outer"), s["inner"].alias("inner"), F.lit("").alias("out"))
    runs = F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / RUN).cast("int"))

    def run(s: Column, k: Column) -> Column:
        one = F.aggregate(F.slice(marks, k * RUN + 1, F.lit(RUN)), again(s["now"]), step)
        return F.struct(one.alias("now"), F.array_append(s["all"], one["out"]).alias("all"))

    start = F.struct(empty.alias("now"), F.array().cast("array<string>").alias("all"))
    said = F.split(F.array_join(F.aggregate(runs, start, run)["all"], ""), "")
    joined = F.array_join(F.zip_with(gaps, said, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(marks) > 0, joined).otherwise(column)


#: White space that a line may have at its ends.
_EDGE = r"[\t-\r\x1C-\x20  -  -    　]+"


def quote_issues(column: Column) -> Column:
    """array<struct<line_number, text>>: lines whose first and last marks are a pair turned round or of two kinds.

    Built-in functions only. Null has no issues.
    """
    lines = F.split(F.regexp_replace(F.coalesce(column, F.lit("")), "\r\n|\r", "\n"), "\n")
    numbered = F.transform(lines, lambda x, k: F.struct((k + 1).alias("line_number"), x.alias("text")))

    def suspicious(x: Column) -> Column:
        bare = F.regexp_replace(x["text"], f"^{_EDGE}|{_EDGE}$", "")
        ends = F.concat(F.left(bare, F.lit(1)), F.right(bare, F.lit(1)))
        reversed_pair = ends.rlike(f"^[{CLOSERS}][{OPENERS}]$")
        mixed = ends.rlike(f"^[{OPENERS}][{CLOSERS}]$") & ~ends.isin(*(a + b for a, b in (OUTER | INNER).items()))
        return (F.length(bare) >= 2) & (reversed_pair | mixed)

    return F.filter(numbered, suspicious)


def first_issue(issues: Column) -> Column:
    return F.try_element_at(issues, F.lit(1))


#: The summary's sentences.
NO_ISSUES = "No suspicious dialog quote issues found."
ISSUES = """ suspicious dialog quote line(s).

Hint:
The actual typo is often a missing, extra, reversed, or mixed dialog quote.
It may appear on the reported line or a few lines above it.
Fix the source text and validate again."""


def summary(issues: Column) -> Column:
    """What there is to say of the issues of a text."""
    return F.when(is_valid(issues), NO_ISSUES).otherwise(F.concat(F.lit("Found "), F.size(issues).cast("string"), F.lit(ISSUES)))


def is_valid(issues: Column) -> Column:
    return F.size(issues) == 0
