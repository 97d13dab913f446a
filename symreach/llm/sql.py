"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from fractions import Fraction

from . import license, quality
from .common import LOWER, UPPER

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "regexp_extract_all({}, '[^ \\x09-\\x0D]+')"


def _ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _license() -> str:
    t = Fraction(license.LEAST)
    low, high = t / (2 - t), (2 - t) / t
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(license.TEMPLATES.items()))
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    grams = "CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) ELSE w END"
    breaks = "regexp_split_to_array(text, '\\n[ \\t\\r]*(?:\\n[ \\t\\r]*)+')"
    return f"""WITH lines AS (SELECT doc_id, 'line' AS scope, unnest(range(0, len(u))) AS unit, unnest(u) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE text IS NOT NULL)),
paragraphs AS (SELECT * FROM (SELECT doc_id, 'paragraph' AS scope, unnest(range(0, len(u))) AS unit, unnest(u) AS u FROM (SELECT doc_id, {breaks} AS u FROM documents WHERE text IS NOT NULL)) WHERE contains(u, chr(10))),
whole AS (SELECT doc_id, 'text' AS scope, 0 AS unit, text AS u FROM documents WHERE len({breaks}) > 1),
units AS (SELECT *, {grams} AS g FROM (SELECT doc_id, scope, unit, {words.format("u")} AS w FROM (SELECT * FROM lines UNION ALL SELECT * FROM paragraphs UNION ALL SELECT * FROM whole))),
own AS (SELECT license, {grams} AS o FROM (SELECT license, {words.format("t")} AS w FROM (VALUES {rows}) v(license, t))),
found AS (SELECT doc_id, scope, unit, license, 2 * len(list_intersect(g, o)) / (len(g) + len(o))::DOUBLE AS dice FROM units JOIN own ON len(g) * {low.denominator} >= len(o) * {low.numerator} AND len(g) * {high.denominator} <= len(o) * {high.numerator})
SELECT doc_id, scope, CAST(unit AS INT) AS unit, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, scope, unit ORDER BY dice DESC, license) AS i FROM found WHERE dice >= {license.LEAST}) WHERE i = 1"""


NEAR = f"""WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(_ascii_lower("coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id"""

LINES = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM split),
keyed AS (SELECT *, {_ascii_lower(f"trim(line, {_SPACES})")} AS k FROM lines),
held AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
decided AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN held ON held.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM decided GROUP BY doc_id"""

TOP = """WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum([q.e[i] * c.e[i] for i in range(1, least(len(q.e), len(c.e)) + 1)]), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def _quality() -> str:
    p = quality.RISK / len(quality.RULES)
    top = quality.LEVELS - 1
    level = lambda a, b, n: f"CAST(least({top}, floor({a} * {n} / greatest({b}, 1)::DOUBLE)) AS INT)"
    levels = ", ".join(f"{level(*x)} AS {r}" for r, x in zip(quality.RULES, (("n_symbols", "word_chars", 200), ("n_dup_lines", "n_lines", quality.LEVELS), ("n_repeat_words", "n_words", 300), ("word_chars", "n_words", 2), ("n_words", "word_chars", quality.LEVELS))))
    each = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS level FROM held" for r in quality.RULES)
    hit = " OR ".join(f"EXISTS (SELECT 1 FROM cutoffs c WHERE c.stratum = f.stratum AND c.rule = '{r}' AND f.{r} >= c.cutoff)" for r in quality.RULES)
    return f"""WITH raw AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, {_WORDS.format("t")} AS w, [x for x in string_split(t, chr(10)) if trim(x, {_SPACES}) <> ''] AS l FROM raw),
g AS (SELECT *, CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [] END AS grams FROM split),
windows AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(0, len(grams))) AS i FROM g),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
counts AS (SELECT g.doc_id AS doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN covered ON covered.doc_id = g.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {levels} FROM counts),
held AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
each AS ({each}),
total AS (SELECT stratum, rule, count(*) AS n FROM each GROUP BY stratum, rule),
grid AS (SELECT total.stratum AS stratum, total.rule AS rule, c.c AS c, any_value(n) AS n, count(level) AS k FROM total CROSS JOIN (SELECT unnest(range(1, {top + 1})) AS c) c LEFT JOIN each ON each.stratum = total.stratum AND each.rule = total.rule AND level >= c.c GROUP BY ALL),
tests AS (SELECT stratum, rule, c, CASE WHEN k <= n * {p} THEN list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})) for j in range(0, k + 1)]) ELSE 1 END AS chance FROM grid),
cutoffs AS (SELECT stratum, rule, min(c) AS cutoff FROM tests WHERE chance <= {quality.ERROR} / (SELECT count(*) FROM total) GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hit}) AS kept FROM f"""


ORACLES = {"op1_license_scan": _license(), "op2_minhash": NEAR, "op3_line_dedup": LINES, "op9_exact_top_k": TOP, "op10_quality_rules": _quality()}
