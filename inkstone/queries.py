"""The registered queries of the library, by name, and their SQL.

The test tables have no Han characters, so the queries derive Han text from `documents`: some words become phrase keys
and the letters become characters that the configuration changes.
"""

from __future__ import annotations

from itertools import cycle, islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.functions import quotes, reflow, search, sql
from inkstone.operators import convert as conversion
from inkstone.plans.conversion import ROUNDS, plan
from inkstone.sources import containers, dictionary_tables, documents
from inkstone.sources.archives import pack_archives
from inkstone.sources.dictionaries import CustomSpec, apply_specs, example_slots

SLOTS = example_slots()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Configurations for which the example set has all slots.
COMPLETE = [c for c, rounds in ROUNDS.items() if all(s in SLOTS for r in rounds for s in r)]
WORDS = ("the", "de", "und", "la", "to", "of")
#: Example slots of a user, for the configurations whose slots this repository lacks.
OWN = [
    CustomSpec.from_pairs("st_characters", dict(zip("汉字转换测试爱国书车门马", "漢字轉換測試愛國書車門馬", strict=True))),
    CustomSpec.from_pairs("ts_characters", dict(zip("漢轉換測試愛國書車門馬", "汉转换测试爱国书车门马", strict=True))),
    CustomSpec.from_pairs("st_phrases", {"汉字转换": "漢字轉換", "爱国书": "愛國書籍"}),
    CustomSpec.from_pairs("ts_phrases", {"漢字轉換": "汉字转换", "愛國書籍": "爱国书"}),
]
OWN_SLOTS = apply_specs(SLOTS, OWN)
CUSTOM_CONFIGS = ("s2t", "s2tw", "s2twp", "tw2s", "tw2sp", "t2s", "s2hk", "s2hkp", "hk2s", "hk2sp")


def alphabet(config: str, slots) -> tuple[str, list[str]]:
    """26 characters and a few phrases that the first round of a configuration changes."""
    pairs = plan(config, slots)[0].pairs
    single = [k for k, v in pairs.items() if len(k) == 1 and k != v]
    phrases = sorted((k for k, v in pairs.items() if len(k) > 1), key=lambda k: (pairs[k] == k, k)) or single
    return "".join(islice(cycle(single), 26)), list(islice(cycle(phrases), len(WORDS)))


def han(text: Column, config: str, slots) -> Column:
    letters, phrases = alphabet(config, slots)
    out = F.lower(text)
    for word, phrase in zip(WORDS, phrases, strict=True):
        out = F.replace(out, F.lit(f" {word} "), F.lit(phrase))
    return F.translate(out, LETTERS, letters)


def han_sql(config: str, slots) -> str:
    letters, phrases = alphabet(config, slots)
    out = "lower(text)"
    for word, phrase in zip(WORDS, phrases, strict=True):
        out = f"replace({out}, ' {word} ', '{phrase}')"
    return f"translate({out}, '{LETTERS}', '{letters}')"


def convert_sql(text: str, config: str, slots, punctuation: bool = False) -> str:
    """Longest match, as an alternation of the keys from the longest down."""
    for r in plan(config, slots, punctuation):
        if r.single and all(len(v) == 1 for v in r.pairs.values()):
            text = f"translate({text}, '{''.join(r.pairs)}', '{''.join(r.pairs.values())}')"
            continue
        keys = sorted(r.pairs, key=lambda k: (-len(k), k))
        mapping = "MAP {" + ", ".join(f"'{k}': '{r.pairs[k]}'" for k in keys) + "}"
        text = f"array_to_string(list_transform(regexp_extract_all({text}, '{'|'.join(keys)}|(?s:.)'), lambda x: coalesce(({mapping})[x], x)), '')"
    return text


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _convert(config: str, slots):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", han(F.col("text"), config, slots).alias("han"))
        out = rows.withColumn("text", conversion.convert(spark, F.col("han"), config, slots))
        return out.select("doc_id", "text", (F.col("text") != F.col("han")).alias("changed"))

    sql = f"WITH h AS (SELECT doc_id, {han_sql(config, slots)} AS han FROM documents), c AS (SELECT doc_id, han, {convert_sql('han', config, slots)} AS text FROM h) SELECT doc_id, text, text <> han AS changed FROM c"
    return run, sql


def convert_t2hkp_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents that t2hkp changes, by language."""
    rows = docs(spark, sf_dir).select("lang", han(F.col("text"), "t2hkp", SLOTS).alias("han"))
    out = rows.withColumn("text", conversion.convert(spark, F.col("han"), "t2hkp", SLOTS))
    return out.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum((F.col("text") != F.col("han")).cast("long")).alias("n_changed"))


FLAGSHIP_SQL = f"WITH h AS (SELECT lang, {han_sql('t2hkp', SLOTS)} AS han FROM documents) SELECT lang, count(*) AS n_docs, sum(({convert_sql('han', 't2hkp', SLOTS)} <> han)::BIGINT)::BIGINT AS n_changed FROM h GROUP BY lang"


#: Example tables of a user for the ends of the chain: compatibility ideographs, and rare ideographs with their extensions.
COMPATIBILITY = {"\uf900": "\u8c48", "\uf901": "\u66f4", "\uf902": "\u8eca", "\uf903": "\u8cc8", "\uf904": "\u6ed1"}
RARE = [("\U0002003e", "漢", "B"), ("\U0002a700", "車", "C"), ("\U0002b740", "測", "D")]
CHAIN_TEXT = "\uf900\uf901\uf902\uf903\uf904\U0002003e\U0002a700\U0002b740汉字转换测试爱国书车门马“”‘"


def convert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility ideographs, s2t with punctuation, and rare ideographs from extension C on, in this order."""
    han_text = F.translate("text", "abcdefghijklmnopqrstuvw", CHAIN_TEXT)
    rows = docs(spark, sf_dir).select("doc_id", han_text.alias("han"))
    out = conversion.convert_text(spark, F.col("han"), "s2t", OWN_SLOTS, True, COMPATIBILITY, RARE, "C")
    return rows.select("doc_id", out.alias("text"))


CHAIN_SQL = f"""
WITH h AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvw', '{CHAIN_TEXT}') AS han FROM documents),
c AS (SELECT doc_id, translate(han, '\uf900\uf901\uf902\uf903\uf904', '\u8c48\u66f4\u8eca\u8cc8\u6ed1') AS text FROM h),
p AS (SELECT doc_id, replace(replace(text, '汉字转换', '漢字轉換'), '爱国书', '愛國書籍') AS text FROM c),
s AS (SELECT doc_id, translate(text, '汉字转换测试爱国书车门马“”‘', '漢字轉換測試愛國書車門馬「」『') AS text FROM p)
SELECT doc_id, translate(text, '\U0002a700\U0002b740', '車測') AS text FROM s
"""


def script_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, han(F.col("text"), "s2t", OWN_SLOTS)).when(F.col("doc_id") % 3 == 1, han(F.col("text"), "t2s", OWN_SLOTS)).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", conversion.script_check(text, OWN_SLOTS["st_characters"], OWN_SLOTS["ts_characters"]).alias("script"))


def _script_sql() -> str:
    st, ts = OWN_SLOTS["st_characters"], OWN_SLOTS["ts_characters"]
    tr = lambda p: f"translate(told, '{''.join(p)}', '{''.join(p.values())}')"
    return rf"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {han_sql('s2t', OWN_SLOTS)} WHEN doc_id % 3 = 1 THEN {han_sql('t2s', OWN_SLOTS)} ELSE text END AS t FROM documents),
s AS (SELECT doc_id, substr(regexp_replace(substr(t, 1, 500), '[!-/:-@\[-`{{-~\t\n\x0B\f\r 0-9A-Za-z_著]', '', 'g'), 1, 100) AS told FROM t)
SELECT doc_id, CASE WHEN told = '' OR told IS NULL THEN 0 WHEN {tr(ts)} <> told THEN 1 WHEN {tr(st)} <> told THEN 2 ELSE 0 END AS script FROM s
"""


def convert_quotation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate("text", ".,", "“”")
    return docs(spark, sf_dir).select("doc_id", conversion.convert_quotes(text, "s2t").alias("text"))


def repair_dialog_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stops stand for plain double marks here."""
    return docs(spark, sf_dir).select("doc_id", quotes.repair_quotes(F.translate("text", ".", '"')).alias("text"))


REPAIR_SQL = """
WITH p AS (SELECT doc_id, string_split(replace(text, '.', '"'), '"') AS parts FROM documents)
SELECT doc_id, array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN '“' || x ELSE '”' || x END), '') AS text FROM p
"""


def repair_nested_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, single and corner marks of both levels, in place of some letters and stops."""
    text = F.translate("text", ".,qzxv", "\"'「』”‘")
    return docs(spark, sf_dir).select("doc_id", quotes.repair_quotes(text, keep_apostrophes=False).alias("text"))


#: The state is a string: the mark due of the outer level, of the inner one, then all marks so far.
NESTED_SQL = """
WITH d AS (SELECT doc_id, translate(text, '.,qzxv', '"''「』”‘') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '["''「』”‘’“」『]') AS marks, string_split_regex(t, '["''「』”‘’“」『]') AS gaps FROM d),
f AS (SELECT *, list_reduce(list_prepend('00', marks), lambda s, m: (
    CASE WHEN m IN ('“', '「') OR (m = '"' AND s[1] = '0') THEN CASE WHEN m = '「' THEN '」' ELSE '”' END WHEN m IN ('"', '”', '」') THEN '0' ELSE s[1] END
    || CASE WHEN m IN ('‘', '『') OR (m = '''' AND s[2] = '0') THEN CASE WHEN m = '『' THEN '』' ELSE '’' END WHEN m IN ('''', '’', '』') THEN '0' ELSE s[2] END
    || s[3:] || CASE WHEN m = '"' THEN CASE s[1] WHEN '0' THEN '“' ELSE s[1] END WHEN m = '''' THEN CASE s[2] WHEN '0' THEN '‘' ELSE s[2] END ELSE m END))[3:] AS said FROM m)
SELECT doc_id, array_to_string(list_transform(gaps, lambda g, i: g || said[i:i]), '') AS text FROM f
"""


def unclosed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether brackets and dialog marks, in place of some letters, are left open."""
    text = F.translate("text", "qzxvkj", "「」（）《》")
    return docs(spark, sf_dir).select("doc_id", reflow.open_bracket(text).alias("bracket"), reflow.open_quote(text).alias("quote"))


OPEN_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'qzxvkj', '「」（）《》'), '[「」『』“”‘’﹁﹂﹃﹄]') AS q,
             regexp_extract_all(translate(text, 'qzxvkj', '「」（）《》'), '[（）()\[\]［］{}｛｝<>＜＞〈〉【】《》〔〕〖〗]') AS b FROM documents),
e AS (SELECT doc_id, list_reduce(list_prepend('', b), lambda s, m: CASE
    WHEN m IN ('（', '(', '[', '［', '{', '｛', '<', '＜', '〈', '【', '《', '〔', '〖') THEN s || translate(m, '（([［{｛<＜〈【《〔〖', '）)]］}｝>＞〉】》〕〗')
    WHEN right(s, 1) = m THEN left(s, length(s) - 1) ELSE '!' || left(s, greatest(length(s) - 1, 0)) END) <> '' AS bracket,
  len(list_filter(['「」', '『』', '“”', '‘’', '﹁﹂', '﹃﹄'], lambda p: list_reduce(list_prepend(0, list_transform(q, lambda x: CASE WHEN x = p[1] THEN 1 WHEN x = p[2] THEN -1 ELSE 0 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) <> 0)) > 0 AS quote FROM d)
SELECT doc_id, bracket, quote FROM e
"""


def dialog_quote_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with wrong pairs, where a line begins with an opening mark and its full stops are closing ones."""
    text = F.translate(F.concat(F.lit("「"), F.replace("text", F.lit("\n"), F.lit("\n“"))), ".", "”")
    return docs(spark, sf_dir).select("doc_id", F.size(quotes.quote_issues(text)).cast("long").alias("n_issues"), quotes.first_issue(quotes.quote_issues(text))["line_number"].cast("long").alias("first_line"))


ISSUES_SQL = r"""
WITH l AS (SELECT doc_id, string_split('「' || replace(replace(text, chr(10), chr(10) || '“'), '.', '”'), chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, list_transform(lines, lambda x: left(trim(x, ' ' || chr(9)), 1) || right(trim(x, ' ' || chr(9)), 1)) AS ends, lines FROM l),
n AS (SELECT doc_id, list_filter(range(1, len(ends) + 1), lambda i: length(trim(lines[i], ' ' || chr(9))) >= 2 AND (regexp_matches(ends[i], '^[”’」』][“‘「『]$') OR (regexp_matches(ends[i], '^[“‘「『][”’」』]$') AND ends[i] NOT IN ('“”', '‘’', '「」', '『』')))) AS bad FROM b)
SELECT doc_id, len(bad)::BIGINT AS n_issues, bad[1]::BIGINT AS first_line FROM n
"""


def find_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = search.replace_all(F.col("text"), "THE ", "$a\\ ", match_case=False)
    found = search.find_next(F.col("text"), "the", 100)
    return docs(spark, sf_dir).select("doc_id", done["outcome"].alias("outcome"), done["text"].alias("text"), done["count"].cast("long").alias("n"), found["outcome"].alias("next_outcome"), found["start"].cast("long").alias("next_start"))


FIND_SQL = r"""
WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)the ')) AS n, strpos(substr(text, least(100, length(text)) + 1), 'the') AS after, strpos(text, 'the') AS first FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN 'FOUND' ELSE 'NO_MATCH' END AS outcome, regexp_replace(text, '(?i)the ', '$a\\ ', 'g') AS text, n::BIGINT AS n,
  CASE WHEN after > 0 THEN 'FOUND' WHEN first > 0 THEN 'WRAPPED' ELSE 'NO_MATCH' END AS next_outcome,
  (CASE WHEN after > 0 THEN least(100, length(text)) + after - 1 WHEN first > 0 THEN first - 1 ELSE -1 END)::BIGINT AS next_start FROM d
"""


def find_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.find_previous(F.col("text"), "the", 300)
    return docs(spark, sf_dir).select("doc_id", found["outcome"].alias("outcome"), found["start"].cast("long").alias("start"))


PREVIOUS_SQL = """
WITH d AS (SELECT doc_id, text, strpos(reverse(substr(text, 1, 300)), 'eht') AS before, strpos(reverse(text), 'eht') AS last FROM documents)
SELECT doc_id, CASE WHEN before > 0 THEN 'FOUND' WHEN last > 0 THEN 'WRAPPED' ELSE 'NO_MATCH' END AS outcome,
  (CASE WHEN before > 0 THEN least(300, length(text)) - before - 2 WHEN last > 0 THEN length(text) - last - 2 ELSE -1 END)::BIGINT AS start FROM d
"""


def find_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From place 60: a word of three letters from t on, and backwards a run of full stops, or the end."""
    found = search.find_match(F.col("text"), r"(?<![a-z])t\w\w(?!\w)", 60, regex=True)
    before = search.find_match(F.col("text"), r"[.]+|\z", 60, backwards=True, regex=True)
    told = [(r[c] if c == "outcome" else r[c].cast("long")).alias(f"{n}_{c}") for n, r in (("next", found), ("previous", before)) for c in ("outcome", "start", "end")]
    return docs(spark, sf_dir).select("doc_id", *told)


MATCH_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, '') AS c, least(60, length(text)) AS caret, length(text) AS n FROM documents),
w AS (SELECT *, list_transform(c, lambda x: regexp_matches(x, '[0-9A-Za-z_]')) AS w FROM d),
p AS (SELECT *, list_filter(range(1, n - 1), lambda i: c[i] = 't' AND (i = 1 OR NOT c[i - 1] BETWEEN 'a' AND 'z') AND w[i + 1] AND w[i + 2] AND (i + 3 > n OR NOT w[i + 3])) AS p,
        list_filter(range(1, n + 1), lambda i: c[i] = '.' AND (i = n OR c[i + 1] <> '.')) AS stops,
        list_filter(range(1, n + 1), lambda i: c[i] = '.' AND (i = 1 OR c[i - 1] <> '.')) AS heads FROM w),
b AS (SELECT *, list_filter(p, lambda i: i > caret)[1] AS after, p[1] AS first, list_filter(stops, lambda i: i <= caret)[-1] AS stop FROM p)
SELECT doc_id, CASE WHEN after IS NOT NULL THEN 'FOUND' WHEN first IS NOT NULL THEN 'WRAPPED' ELSE 'NO_MATCH' END AS next_outcome,
  coalesce(after, first, 0)::BIGINT - 1 AS next_start, coalesce(after + 2, first + 2, -1)::BIGINT AS next_end,
  CASE WHEN stop IS NOT NULL THEN 'FOUND' ELSE 'WRAPPED' END AS previous_outcome,
  coalesce(list_filter(heads, lambda i: i <= stop)[-1] - 1, n)::BIGINT AS previous_start, coalesce(stop, n)::BIGINT AS previous_end FROM b
"""


def quote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same texts as `dialog_quote_issues`."""
    text = F.translate(F.concat(F.lit("「"), F.replace("text", F.lit("\n"), F.lit("\n“"))), ".", "”")
    return docs(spark, sf_dir).select("doc_id", quotes.summary(quotes.quote_issues(text)).alias("summary"))


SUMMARY_SQL = ISSUES_SQL.replace("SELECT doc_id, len(bad)::BIGINT AS n_issues, bad[1]::BIGINT AS first_line FROM n", r"""
SELECT doc_id, CASE WHEN len(bad) = 0 THEN 'No suspicious dialog quote issues found.' ELSE 'Found ' || len(bad) || ' suspicious dialog quote line(s).' || chr(10) || chr(10) || 'Hint:' || chr(10)
  || 'The actual typo is often a missing, extra, reversed, or mixed dialog quote.' || chr(10) || 'It may appear on the reported line or a few lines above it.' || chr(10)
  || 'Fix the source text and validate again.' END AS summary FROM n""")


def script_check_converting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters become simplified, traditional or neutral characters, by the document."""
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ae", "汉马")).when(F.col("doc_id") % 3 == 1, F.translate("text", "ae", "漢馬")).otherwise(F.translate("text", "ae", "中文"))
    return docs(spark, sf_dir).select("doc_id", conversion.script_check_converting(spark, text, OWN_SLOTS).alias("script"))


CONVERTING_SQL = r"""
WITH t AS (SELECT doc_id, translate(text, 'ae', CASE doc_id % 3 WHEN 0 THEN '汉马' WHEN 1 THEN '漢馬' ELSE '中文' END) AS t FROM documents),
s AS (SELECT doc_id, substr(regexp_replace(t, '[!-/:-@\[-`{-~\t\n\x0B\f\r 0-9A-Za-z_著]', '', 'g'), 1, 50) AS told FROM t)
SELECT doc_id, CASE WHEN told = '' OR told IS NULL THEN 0 WHEN regexp_matches(told, '[漢馬]') THEN 1 WHEN regexp_matches(told, '[汉马]') THEN 2 ELSE 0 END AS script FROM s
"""


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the documents, every third one as a PDF file, in the order of the documents."""
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".txt"))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(name.alias("path"), F.col("doc_id").alias("added"))
    return documents.order_files(files).select("path", F.col("position").cast("long").alias("position"))


ORDER_SQL = """
WITH f AS (SELECT source || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.txt' END AS path, min(doc_id) AS added FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT path, (row_number() OVER (ORDER BY path LIKE '%.pdf', CASE WHEN path LIKE '%.pdf' THEN '' ELSE path END, added) - 1)::BIGINT AS position FROM f
"""


def utf16_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", search.utf16_length(F.translate("text", "e", "𠀾")).cast("long").alias("n_units"))


def go_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("text", "\n"))
    asked = search.go_to_line(F.concat(F.lit(" "), (F.col("doc_id") % 7 - 1).cast("string")), lines)
    return docs(spark, sf_dir).select("doc_id", asked["valid"].alias("valid"), asked["paragraph_index"].cast("long").alias("paragraph_index"), asked["message"].alias("message"))


GO_SQL = """
WITH d AS (SELECT doc_id, doc_id % 7 - 1 AS n, len(string_split(text, chr(10))) AS lines FROM documents),
m AS (SELECT *, CASE WHEN n <= 0 THEN 'Line number must be positive' WHEN n > lines THEN 'Line must be between 1 and ' || lines END AS message FROM d)
SELECT doc_id, message IS NULL AS valid, (CASE WHEN message IS NULL THEN n - 1 ELSE -1 END)::BIGINT AS paragraph_index, message FROM m
"""


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a page."""
    return docs(spark, sf_dir).select("doc_id", documents.assemble_pages(F.split("text", "\n"), header=True).alias("text"))


PAGES_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: '=== [Page ' || i || '/' || len(p) || '] ===' || chr(10) || chr(10) || x || chr(10) || chr(10)), '') AS text FROM d
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", documents.html_text(F.col("html")).alias("text"))


PAGE_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<svg\b[^>]*>.*?</svg\s*>', '', 'g'), '(?is)<math\b[^>]*>.*?</math\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|section|article|h[1-6]|li|tr|blockquote|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM c),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM d),
f AS (SELECT page_id, replace(replace(t, chr(160), ' '), chr(173), '') AS t FROM e)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r]*\n[ \t\r]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM f
"""


def replace_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection is the first `the`, or one character beside it."""
    at = F.instr("text", "the") - 1 + F.col("doc_id") % 2
    done = search.replace_current(F.col("text"), "the", "$1\\", at.cast("int"), (at + 3).cast("int"))
    return docs(spark, sf_dir).select("doc_id", *(done[c].alias(c) for c in ("outcome", "text")), *(done[c].cast("long").alias(f"selected_{c}") for c in ("start", "end")))


CURRENT_SQL = r"""
WITH d AS (SELECT doc_id, text, strpos(text, 'the') AS place, strpos(text, 'the') > 0 AND doc_id % 2 = 0 AS hit FROM documents)
SELECT doc_id, CASE WHEN hit THEN 'FOUND' ELSE 'NOT_COMPLETE_MATCH' END AS outcome,
  CASE WHEN hit THEN substr(text, 1, place - 1) || '$1\' || substr(text, place + 3) ELSE text END AS text,
  (CASE WHEN hit THEN place - 1 ELSE -1 END)::BIGINT AS selected_start, (CASE WHEN hit THEN place + 2 ELSE -1 END)::BIGINT AS selected_end FROM d
"""


def files_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each document as a DOCX, an ODT or an EPUB file, by its id; commas of DOCX and ODT files are tabs."""
    member = lambda name, *parts: F.struct(F.lit(name).alias("member"), F.encode(F.concat(*parts), "UTF-8").alias("content"))
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;"))
    lines = F.split(escaped, "\n")
    each = lambda head, tail, tab=None: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(head), x if tab is None else F.replace(x, F.lit(","), F.lit(tab)), F.lit(tail))), "")
    docx = F.array(
        member("[Content_Types].xml", F.lit("<Types/>")),
        member("word/document.xml", F.lit('<w:document xmlns:w="w"><w:body>'), each('<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>", '</w:t><w:tab/><w:t xml:space="preserve">'), F.lit("</w:body></w:document>")),
        member("word/header1.xml", F.lit('<w:hdr xmlns:w="w"><w:tbl><w:tr><w:tc><w:p><w:r><w:t>'), F.col("doc_id").cast("string"), F.lit("</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>n</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:hdr>")),
    )
    odt = F.array(
        member("mimetype", F.lit(containers.ODT_TYPE)),
        member("content.xml", F.lit('<o xmlns:text="t">'), each("<text:p>", "</text:p>", "<text:tab/>"), F.lit("</o>")),
    )
    epub = F.array(
        member("mimetype", F.lit("application/epub+zip")),
        member("META-INF/container.xml", F.lit('<container><rootfiles><rootfile full-path="OPS/a.opf"/></rootfiles></container>')),
        member("OPS/b.xhtml", F.lit("<html><head><title>no</title></head><body>"), each("<p>", "</p>"), F.lit("</body></html>")),
        member("OPS/a.xhtml", F.lit("<html><body><h1>"), F.col("doc_id").cast("string"), F.lit("</h1></body></html>")),
        member("OPS/a.opf", F.lit('<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="./a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')),
    )
    kind = F.col("doc_id") % 3
    ending = F.when(kind == 0, ".docx").when(kind == 1, ".odt").otherwise(".epub")
    rows = docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), ending).alias("path"), F.when(kind == 0, docx).when(kind == 1, odt).otherwise(epub).alias("members"))
    return pack_archives(rows)


def container_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the files that `files_of_documents` makes."""
    return containers.container_texts(files_of_documents(spark, sf_dir))


CONTAINER_SQL = r"""
WITH d AS (SELECT doc_id, doc_id % 3 AS k, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT *, list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[ \t\r\n\x0B\f]+', ' ', 'g'), ' ')), lambda x: x <> '') AS blocks FROM d)
SELECT doc_id || CASE k WHEN 0 THEN '.docx' WHEN 1 THEN '.odt' ELSE '.epub' END AS path, CASE k WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' ELSE 'epub' END AS kind,
  CASE k WHEN 0 THEN array_to_string(list_transform(lines, lambda x: replace(x, ',', chr(9)) || chr(10)), '') || doc_id || chr(9) || 'n' || chr(10)
    WHEN 1 THEN array_to_string(list_transform(lines, lambda x: replace(x, ',', chr(9)) || chr(10)), '')
    ELSE replace(replace(array_to_string(list_transform(list_prepend(doc_id::VARCHAR, blocks), lambda x: x || chr(10) || chr(10)), ''), chr(160), ' '), chr(173), '') END AS text,
  NULL::VARCHAR AS error FROM e
"""


def reflow_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han text cut into lines of 40 characters or at its full stops."""
    text = F.translate(han(F.col("text"), "t2hkp", SLOTS), ".", "。")
    cut = F.regexp_replace(text, r"([^\n]{40})", "$1\n")
    return reflow.reflow_texts(docs(spark, sf_dir).select("doc_id", cut.alias("text")))


def sql_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages of a document, converted and put together by SQL text alone."""
    sql.register(spark, SLOTS)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns.select("conv_id", "turn", "role", han(F.col("text"), "t2tw", SLOTS).alias("han")).createOrReplaceTempView("inkstone_turns")
    return spark.sql("""
        SELECT doc AS conv_id, position, start, piece
        FROM inkstone_pages(TABLE(
            SELECT conv_id AS doc, turn AS page, role, count(*) OVER (PARTITION BY conv_id) AS n_pages, inkstone_convert(han, ' T2TW ') AS text FROM inkstone_turns
        ) PARTITION BY doc ORDER BY (page, role, text))""")


SQL_PAGES_SQL = f"""
WITH h AS (SELECT conv_id, turn, role, {han_sql('t2tw', SLOTS)} AS han FROM conversations),
c AS (SELECT conv_id, turn, role, {convert_sql('han', 't2tw', SLOTS)} AS text FROM h),
p AS (SELECT conv_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS text FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
s AS (SELECT conv_id, position, '=== [Page ' || position || '/' || n || '] ===' || chr(10) || chr(10) || text || chr(10) || chr(10) AS piece FROM p)
SELECT conv_id, position::INT AS position, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, piece FROM s
"""


def _dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of dictionaries: of two slots, one unknown one and three files, of which the second overrides."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    slot = F.element_at(F.array(F.lit("tw_phrases"), F.lit(" HK_Phrases "), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int"))
    file = (F.col("doc_id") / 100 % 3).cast("int")
    text = F.regexp_replace("raw", "^([^ ]+) ", "$1\t")
    return lines.select(slot.alias("slot"), F.when(file == 1, "override").otherwise("append").alias("mode"), file.alias("file"), (F.col("doc_id") * 1_000_000 + F.col("at") + 2).alias("line"), text.alias("text"))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_tables.merge_entries(dictionary_tables.parse_lines(_dictionary_lines(spark, sf_dir)))


def dictionary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_tables.problems(dictionary_tables.parse_lines(_dictionary_lines(spark, sf_dir)))


_LINES_SQL = r"""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS nth FROM documents),
l AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'tw_phrases' WHEN 1 THEN 'hk_phrases' ELSE 'none' END AS slot, (doc_id / 100 % 3)::DOUBLE AS f, doc_id * 1000000 + nth + 2 AS line, regexp_replace(raw, '^([^ ]+) ', '\1' || chr(9)) AS text FROM e),
t AS (SELECT slot, floor(f)::INT AS file, line, text, trim(text, ' ' || chr(9) || chr(13)) AS s FROM l),
k AS (SELECT *, string_split(s, chr(9)) AS parts, regexp_extract(s, '^[^\t]*\t[ \t]*([^ \t]*)', 1) AS value FROM t WHERE s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '//')),
p AS (SELECT slot, file, line, text, parts[1] AS key, value, CASE WHEN slot = 'none' THEN 'unknown slot' WHEN len(parts) < 2 THEN 'no tab' WHEN parts[1] = '' OR value = '' THEN 'empty key or value' END AS problem FROM k)
"""
ENTRIES_SQL = _LINES_SQL + """
, o AS (SELECT slot, max(file) FILTER (file = 1) AS since FROM p GROUP BY slot)
SELECT slot, key, last(value ORDER BY file, line) AS value, count(*)::BIGINT AS n_lines FROM p JOIN o USING (slot) WHERE problem IS NULL AND file >= coalesce(since, 0) GROUP BY slot, key
"""
PROBLEMS_SQL = _LINES_SQL + """
, a AS (SELECT *, count(*) OVER (PARTITION BY slot, file, key, problem IS NULL ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p)
SELECT slot, file, line, text, coalesce(problem, 'replaced by a later line') AS problem FROM a WHERE problem IS NOT NULL OR later > 0
"""


QUERIES: dict = {"convert_t2hkp_by_lang": convert_t2hkp_by_lang}
ORACLES: dict[str, str] = {"convert_t2hkp_by_lang": FLAGSHIP_SQL}
for _config in COMPLETE:
    QUERIES[f"convert_{_config}"], ORACLES[f"convert_{_config}"] = _convert(_config, SLOTS)
for _config in CUSTOM_CONFIGS:
    QUERIES[f"convert_{_config}_custom"], ORACLES[f"convert_{_config}_custom"] = _convert(_config, OWN_SLOTS)
for _f, _sql in (
    (convert_chain, CHAIN_SQL),
    (script_check, _script_sql()),
    (convert_quotation_marks, "SELECT doc_id, translate(translate(text, '.,', '“”'), '“”‘’', '「」『』') AS text FROM documents"),
    (repair_dialog_quotes, REPAIR_SQL),
    (repair_nested_quotes, NESTED_SQL),
    (unclosed_marks, OPEN_SQL),
    (dialog_quote_issues, ISSUES_SQL),
    (find_and_replace, FIND_SQL),
    (find_previous, PREVIOUS_SQL),
    (replace_current, CURRENT_SQL),
    (find_match, MATCH_SQL),
    (quote_summary, SUMMARY_SQL),
    (script_check_converting, CONVERTING_SQL),
    (order_files, ORDER_SQL),
    (reflow_paragraphs, None),
    (utf16_length, "SELECT doc_id, length(text) + length(text) - length(replace(text, 'e', '')) AS n_units FROM documents"),
    (go_to_line, GO_SQL),
    (assemble_pages, PAGES_SQL),
    (page_text, PAGE_SQL),
    (container_texts, CONTAINER_SQL),
    (sql_pages, SQL_PAGES_SQL),
    (dictionary_entries, ENTRIES_SQL),
    (dictionary_problems, PROBLEMS_SQL),
):
    QUERIES[_f.__name__] = _f
    if _sql:
        ORACLES[_f.__name__] = _sql
