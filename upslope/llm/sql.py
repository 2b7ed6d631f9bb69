"""DuckDB SQL with the results of this subpackage's queries, where SQL can express them.

Secret scans need look-around, the recurrent model trains, shards come from a seeded
shuffle, decontamination aligns hits and token records need a tokenizer; the tests
hold those queries against brute force.
"""

from __future__ import annotations

from upslope.llm.line_dedup import _BLOCK, _HIDDEN

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NGRAMS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * o >= 85 * (a.n + b.n - o)),
sides AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
reach AS (SELECT a AS node, a AS hop FROM sides UNION SELECT node, b FROM reach JOIN sides ON hop = a),
c AS (SELECT node, min(hop) AS component FROM reach GROUP BY node), k AS (SELECT a, count(*) AS links FROM sides GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.node LEFT JOIN k ON w.doc_id = k.a"""

_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
b AS (SELECT CAST(sum(source_size) AS DOUBLE) * 3 / 2 AS budget FROM s),
f AS (SELECT *, cap / w AS full_at, (budget - coalesce(sum(cap) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level FROM w CROSS JOIN b
  WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(w * max(CASE WHEN level <= full_at THEN level END) OVER (), cap)) AS target FROM f),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, size, u, ep, CAST(cum + ep * source_size AS DOUBLE) / nullif(target, 0) AS f FROM q CROSS JOIN (VALUES (0), (1)) v(ep) WHERE size > 0),
g AS (SELECT doc_id, sum(size) OVER (ORDER BY f, ep, coalesce(source, ''), u, coalesce(CAST(doc_id AS VARCHAR), '') ROWS UNBOUNDED PRECEDING) AS total FROM e),
c AS (SELECT doc_id, count(*) AS n FROM g CROSS JOIN b WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN c ON q.doc_id IS NOT DISTINCT FROM c.doc_id"""

_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN lines ON w.doc_id = lines.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND 100 * n_symbols <= 30 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_marks <= 50 * n_words AS kept FROM f"""

_RULE = """CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END"""


def _parts(url: str) -> str:
    host = f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}')"
    return f"{host} AS host, regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1) AS query"


_TARGETS = (
    r"(?is)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*\bhref\s*=\s*[\"'']?([^\"''\s>]+)",
    r"(?is)<link\b[^>]*\bhref\s*=\s*[\"'']?([^\"''\s>]+)[^>]*\brel\s*=\s*[\"'']?canonical\b",
    r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*\bcontent\s*=\s*[\"'']?[^>]*?\burl\s*=\s*[\"'']?([^\"''\s>]+)",
)
_LINKS = " UNION ALL ".join(f"SELECT url AS u, nullif(regexp_extract(coalesce(html, ''), '{p}', 1), '') AS t FROM pages" for p in _TARGETS)
_KEY = "CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END"
_SITE = "regexp_extract(u, '(?s)^.*?://[^/?#]*', 0)"
_FOLDER = "coalesce(nullif(regexp_extract(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)[^/]*$', 1), ''), '/')"

_URLS = f"""
WITH RECURSIVE raw AS ({_LINKS}),
full_links AS (SELECT u, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN {_SITE} || t ELSE {_SITE} || {_FOLDER} || t END AS v FROM raw WHERE t IS NOT NULL),
ends AS (SELECT DISTINCT u AS url, {_parts("u")} FROM full_links UNION SELECT DISTINCT v, {_parts("v")} FROM full_links),
nodes AS (SELECT url, {_KEY} AS k, {_RULE} AS rule FROM ends),
e AS (SELECT a.k AS a, b.k AS b FROM full_links JOIN nodes a ON u = a.url JOIN nodes b ON v = b.url WHERE a.k IS NOT NULL AND b.k IS NOT NULL),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS hop FROM sides UNION SELECT node, b FROM reach JOIN sides ON hop = a),
blocked AS (SELECT node FROM reach JOIN nodes ON hop = k GROUP BY node HAVING bool_or(coalesce(rule, '') IN ('example.com/en/', 'net/es/', 'net/fr/')) AND NOT bool_or(coalesce(rule, '') IN ('com/', 'www.example.com/en/'))),
j AS (SELECT page_id, {_parts("url")} FROM pages), r AS (SELECT *, {_RULE} AS rule, {_KEY} AS k FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN blocked ON k = node"""

_LINES = rf"""
WITH shown AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
cut AS (SELECT page_id, host, list_filter(list_transform(string_split_regex(t, '[\n\r]+'), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS lines FROM shown),
hosts AS (SELECT host, count(*) AS host_pages FROM cut GROUP BY host),
held AS (SELECT host, l, count(*) AS n FROM (SELECT DISTINCT page_id, host, unnest(lines) AS l FROM cut) GROUP BY ALL HAVING count(*) >= 5),
bad AS (SELECT host, list(l) AS bad FROM held JOIN hosts USING (host) WHERE n * 10 > host_pages GROUP BY host),
k AS (SELECT page_id, cut.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM cut LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _NGRAMS, "op3_mix_sources": _MIX, "op4_quality_rules": _QUALITY, "op5_url_filter": _URLS, "op10_line_dedup": _LINES}
