"""Quality rules: a table of thresholds compiled into one Spark projection.

Edge cases: a null text has no words and fails the base rule; extra columns, repeated rows and null ids pass through;
an empty table gives an empty result. A ratio over no words or lines is null and breaks no threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Frequent function words of the languages that are kept.
STOP_WORDS = (
    "the of and to a in is that it was for on are as with at by this from be "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la que el en y a los se del las un por con no una su para es al lo "
    "le et les des une du dans qui par pour au il sur ne pas plus est aux"
).split()
STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]


@dataclass(frozen=True)
class Threshold:
    """A document breaks the rule if `metric` is under `low` or over `high`."""

    metric: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        parts = [F.col(self.metric) < self.low] * (self.low is not None) + [F.col(self.metric) > self.high] * (self.high is not None)
        return F.coalesce(reduce(Column.__or__, parts, F.lit(False)), F.lit(False))


#: Mean length of words; symbols, stop words and words of repeated windows per word; repeated lines per line.
DEFAULT_RULES = (
    Threshold("mean_word_length", 2.0, 14.0),
    Threshold("symbol_ratio", high=0.15),
    Threshold("stop_word_ratio", low=0.03),
    Threshold("dup_line_ratio", high=0.5),
)


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_lines n_stop_words n_repeat_words "
    "mean_word_length symbol_ratio stop_word_ratio dup_line_ratio repeat_word_ratio"
).split()


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with its measures, made in a row's own arrays: no shuffle, no function of the user.

    Words of 8-word windows that occur again are counted by sorting the windows' 64-bit hashes with their places, but
    only in documents in which some hash occurs twice.
    """
    col = lambda n: F.col(f"_q_{n}")
    out = docs.withColumn("_q_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumns({"_q_words": F.array_remove(F.split(col("text"), GAP), ""), "_q_lines": F.filter(F.split(col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumns({
        "n_words": F.size(col("words")).cast("long"),
        "word_chars": F.length(F.array_join(col("words"), "")).cast("long"),
        "n_symbols": F.regexp_count(col("text"), F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long"),
        "n_lines": F.size(col("lines")).cast("long"),
        "n_stop_words": F.size(F.filter(col("words"), lambda w: w.isin(STOP_FORMS))).cast("long"),
        "_q_hashes": F.transform(col("words"), lambda w: F.xxhash64(w)),
    }).drop("_q_words", "_q_lines", "_q_text")
    lag = lambda a, k: F.get(col(a), k)
    out = out.withColumn("_q_fours", F.transform(col("hashes"), lambda h, i: F.xxhash64(h, *(lag("hashes", i + k) for k in range(1, 4)))))
    eights = F.transform(col("fours"), lambda h, i: F.xxhash64(h, lag("fours", i + 4)))
    out = out.withColumn("_q_windows", F.when(F.col("n_words") >= WINDOW, F.slice(eights, F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))))
    again = F.size(F.array_distinct(col("windows"))) < F.size(col("windows"))
    out = out.withColumn("_q_sorted", F.when(again, F.sort_array(F.transform(col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.coalesce(F.get(col("sorted"), k)["h"] == x["h"], F.lit(False))
    twins = F.filter(col("sorted"), lambda x, k: twin(x, k - 1) | twin(x, k + 1))
    out = out.withColumn("_q_starts", F.sort_array(F.transform(twins, lambda x: x["i"])))
    covered = F.transform(col("starts"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(col("starts"), k + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    out = out.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    })
    # The measures leave through a generator of one row, as else a filter on them would be pushed below and the whole
    # computation repeated within it, once for each use of each array.
    kept = [c for c in out.columns if c not in MEASURES and not c.startswith("_q_")]
    return out.select(*kept, F.inline(F.array(F.struct(*MEASURES))))


def judge(docs: DataFrame, rules: Sequence[Threshold] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """The measures of `docs` with `base_failed`, `broken` (names of the thresholds that are broken) and `kept`."""
    out = measure(docs, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(r.broken(), F.lit(r.metric)) for r in rules)).cast("array<string>"), lambda x: x.isNotNull())
    return out.withColumns({"base_failed": base, "broken": broken}).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
