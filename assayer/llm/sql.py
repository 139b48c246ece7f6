"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

from assayer.llm import quality_rules as q
from assayer.llm.decontamination import WINDOW_WORDS as W

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD.format("text")}, '{_WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_FOLD.format("text")}, '{_WORD}') AS w FROM benchmark),
b1 AS (SELECT item, w, least({W}, len(w)) AS s, unnest(range(0, len(w) - least({W}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, s, array_to_string(w[i + 1 : i + s], ' ') AS g FROM b1),
sizes AS (SELECT DISTINCT s FROM bw),
d1 AS (SELECT rid, w, s, unnest(range(0, greatest(len(w) - s + 1, 0))) AS i FROM d, sizes),
h AS (SELECT rid, d1.s, i, item FROM d1 JOIN bw ON bw.s = d1.s AND bw.g = array_to_string(w[i + 1 : i + d1.s], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + s)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""

_BLANK = r"[\x20\x09-\x0D]"
_SHARE = "CASE WHEN {1} > 0 THEN least(1000, ({0}) * 1000 // ({1})) ELSE 0 END"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS l FROM documents),
win AS (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i + 1], w[i + 2], w[i + 3]) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper, len(list_filter(w, lambda x: octet_length(encode(x)) = 1)) AS bare FROM d LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(lang, chr(0)) AS stratum,
  [{_SHARE.format("n_symbols", "word_chars")}, {_SHARE.format("n_dup_lines", "lines")}, {_SHARE.format("n_repeat_words", "n_words")}, {_SHARE.format("upper", "word_chars")}, {_SHARE.format("bare", "n_words")}] AS v FROM m),
mark AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
e AS (SELECT stratum, good, unnest(range(1, {len(q.RULES) + 1})) AS k, v FROM r JOIN mark USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, k, v[k] AS b, sum(good)::BIGINT AS good FROM e GROUP BY ALL),
lvl AS (SELECT {q.DELTA} / greatest(1, count(DISTINCT stratum) * {len(q.RULES)}) AS level FROM c),
x AS (SELECT stratum, k, b, sum(good) OVER (PARTITION BY stratum, k ORDER BY b DESC)::BIGINT AS x, sum(good) OVER (PARTITION BY stratum, k)::BIGINT AS n FROM c),
t AS (SELECT stratum, k, b, x, n, unnest(range(0, x + 1)) AS i FROM x WHERE b > 0 AND n > 0 AND x < n),
p AS (SELECT stratum, k, b, sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({q.ALPHA / len(q.RULES)}) + (n - i) * ln(1 - {q.ALPHA / len(q.RULES)}))) AS tail FROM t GROUP BY ALL),
cut AS (SELECT stratum, k, min(b) AS cut FROM p, lvl WHERE tail <= level GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM r JOIN cut USING (stratum) WHERE v[k] >= cut.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM r"""

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""

ORACLE_SQL = {"op11_exact_dedup": EXACT_DEDUP, "op4_quality_rules": QUALITY_RULES, "op7_decontamination": DECONTAMINATION}
