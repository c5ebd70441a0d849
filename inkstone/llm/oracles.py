"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from . import licenses, quality_rules

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM bl),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g
       FROM d, ls WHERE len(w) >= l),
hits AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, g)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM hits)),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op4() -> str:
    ids = {licenses.normal_text(s): k for k, s in licenses.SENTENCES.items()}
    weak = ", ".join(f"'{x}'" for x in licenses.WEAK)
    # Each mark stands twice, so that sentences which follow each other have one each.
    known = f"[SL]({licenses.pattern(licenses.SENTENCES.values())})[SL]"
    values = ", ".join(f"('{s}', '{k}')" for s, k in ids.items())
    # Rule by rule over positions: whatever a rule's sequence covers is marked as taken.
    steps = []
    for k, (name, sequence) in enumerate(licenses.RULES):
        n, wanted = len(sequence), "[" + ", ".join(f"'{x}'" for x in sequence) + "]"
        at = f"list_filter(range(greatest(1, j - {n - 1}), j + 1), lambda i: ids[i:i + {n - 1}] = {wanted})"
        taken = f"list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN len({at}) > 0 THEN '|' ELSE ids[j] END)"
        hit = f"len(list_filter(range(1, len(ids) + 1), lambda i: ids[i:i + {n - 1}] = {wanted})) > 0"
        steps.append(f"r{k + 1} AS (SELECT doc_id, every_id, {taken} AS ids, CASE WHEN {hit} THEN list_append(names, '{name}') ELSE names END AS names FROM r{k})")
    return rf"""
WITH known(s, k) AS (VALUES {values}),
marked AS (SELECT doc_id, 'S' || regexp_replace(replace(regexp_replace(lower(coalesce(text, '')), '([.!?;])[\x20\x09-\x0D]+', '\1S', 'g'), chr(10), 'L'), '[^a-z0-9SL]+', ' ', 'g') || 'S' AS t FROM documents),
normal AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' ?([SL]) ?', '\1', 'g'), '[SL]{{2,}}', 'S', 'g'), '([SL])', '\1\1', 'g') AS t FROM marked),
cut AS (SELECT doc_id, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(t, '{known}', 1) AS runs FROM normal)),
found AS (SELECT doc_id, list(k ORDER BY p) AS ids FROM cut JOIN known ON s = translate(run, 'SL', '  ') GROUP BY doc_id),
r0 AS (SELECT doc_id, ids AS every_id, ids, []::VARCHAR[] AS names FROM found),
{(',' + chr(10)).join(steps)},
named AS (SELECT doc_id, every_id, ids, names, list_filter(names, lambda x: x NOT IN ({weak})) AS strong FROM r{len(licenses.RULES)})
SELECT doc_id, coalesce(len(every_id), 0)::BIGINT AS n_known, coalesce(array_to_string(every_id, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(CASE WHEN len(strong) > 0 THEN strong ELSE names END)), ','), '') AS licenses, coalesce(array_to_string(list_filter(ids, lambda x: x <> '|'), ','), '') AS unmatched
FROM documents LEFT JOIN named USING (doc_id)
"""


OP5 = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (SELECT page_id, host, path, (SELECT max({'n': length(h || rules.p), 'rule': h || rules.p, 'v': v}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)) AS r FROM p)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, 'allow') AS verdict FROM judged
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, {SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.to_id = links.u)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def quality_sql(source: str = "documents") -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
    broken = " OR ".join(f"coalesce({r.metric} < {r.low}, false)" * (r.low is not None) + " OR " * (None not in (r.low, r.high)) + f"coalesce({r.metric} > {r.high}, false)" * (r.high is not None) for r in quality_rules.DEFAULT_RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {source}),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words FROM d LEFT JOIN again USING (doc_id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
        n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM r
"""


def _op3() -> str:
    import re

    from . import chat

    control = "|".join(re.escape(c) for c in chat.CONTROLS)
    escaped = lambda c: f"length(replace({c}, chr(92), chr(92) || chr(92))) + len(regexp_extract_all({c}, '{control}'))"
    around = len("<|turn|><|text|><|end|>\n")
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({around} + {escaped('role')} + {escaped('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


#: CRC-32 of the decimal digits of a number, byte by byte and bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

OP13 = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, {SPACED})) AS words FROM said),
t AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM keyed),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS base, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
head AS (SELECT c, pos AS d, key, words FROM ids JOIN t ON t.conv_id = base AND pos <= h),
given AS (SELECT c, h, count(d) AS m FROM ids LEFT JOIN head USING (c) GROUP BY c, h),
r AS (SELECT * FROM head UNION ALL SELECT c, m + pos - h, key, words FROM given JOIN t ON t.conv_id = c AND pos > h),
p AS (SELECT c, d, words, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT path, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM p GROUP BY c) JOIN p USING (c, d) GROUP BY path),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN kids USING (path)),
sub AS (SELECT p.path, sum((w.n_children = 0)::INT) AS n_leaves, sum(w.saved) AS saved_tokens FROM w JOIN p ON p.c = w.conv_id AND p.d <= w.d GROUP BY p.path)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM w JOIN sub USING (path) LEFT JOIN ends USING (path) LEFT JOIN w up ON w.d > 0 AND up.path = left(w.path, length(w.path) - 64)
"""


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS size, sum(n_lang) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * size) AS p, 1 + 1000000000::HUGEINT * (n_lang + 5) // (lang_total + 5 * size) AS q
      FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(any_value(v), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.t = b.source GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


ORACLES = {
    "op12_source_divergence_audit": OP12,
    "op13_conversation_prefix_trie": OP13,
    "op3_chat_format": _op3(),
    "op1_decontamination": OP1,
    "op4_license_scan": _op4(),
    "op5_url_filter": OP5,
    "op6_ngram_jaccard_join": OP6,
    "op8_quality_rules": quality_sql(),
}
