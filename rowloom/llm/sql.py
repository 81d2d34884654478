"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rowloom.llm import url_filter as U

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _host(url: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') ELSE '' END"


def _part(url: str, pattern: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract({rest}, {_literal(pattern)}, 1) ELSE '' END"


def url_filter() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in U.RULES)
    path = lambda u: _part(u, r"^[^/?#]*([^?#]*)")
    query = lambda u: _part(u, r"^[^?#]*\?([^#]*)")
    kept = lambda u: f"list_sort(list_filter(string_split({query(u)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, {_literal(U.TRACKING)})))"
    key = lambda u: f"({_host(u)}) || ({path(u)}) || CASE WHEN len({kept(u)}) > 0 THEN '?' || array_to_string({kept(u)}, '&') ELSE '' END"
    ruled = lambda t: f"""
  SELECT t.*, r.rule, r.verdict FROM {t} t LEFT JOIN LATERAL (
    SELECT rh || rp AS rule, verdict FROM rules
    WHERE (t.host = rh OR ends_with(t.host, '.' || rh)) AND starts_with(t.path, rp)
    ORDER BY length(rh || rp) DESC, verdict LIMIT 1) r ON true"""  # noqa: E731
    return rf"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
own AS (SELECT page_id, {_host('url')} AS host, {path('url')} AS path, {key('url')} AS node FROM u),
tags AS (SELECT url, unnest(regexp_extract_all(html, {_literal(U.TAG)})) AS tag FROM u),
links AS (
  SELECT url, CASE WHEN regexp_matches(tag, {_literal(U.CANONICAL)}) THEN regexp_extract(tag, {_literal(U.HREF)}, 1)
                   WHEN regexp_matches(tag, {_literal(U.REFRESH)}) THEN regexp_extract(tag, {_literal(U.TARGET)}, 1) END AS link FROM tags),
whole AS (
  SELECT url, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link
                   WHEN starts_with(link, '//') THEN 'x:' || link
                   WHEN starts_with(link, '/') THEN 'x://' || {_host('url')} || link
                   WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN NULL
                   ELSE 'x://' || {_host('url')} || coalesce(nullif(regexp_extract({path('url')}, '^(.*/)', 1), ''), '/') || link END AS target
  FROM links WHERE link <> ''),
e AS (SELECT DISTINCT {key('url')} AS a, {key('target')} AS b FROM whole WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM e WHERE a <> b AND a <> '' AND b <> ''),
reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON reach.other = a),
groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
placed AS (SELECT node, component, {_host("('x://' || node)")} AS host, {path("('x://' || node)")} AS path FROM groups),
ruled AS ({ruled('placed')}),
spread AS (SELECT component, bool_or(verdict = 'allow') AS allows, bool_or(verdict = 'block') AS blocks FROM ruled GROUP BY component),
judged AS ({ruled('own')})
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' END, 'allow') AS verdict, component
FROM judged LEFT JOIN groups USING (node) LEFT JOIN spread USING (component)
"""


#: Polynomial of crc32, reflected; all 32 bits.
CRC, ONES = 3988292384, 4294967295


def _crc32(text: str) -> str:
    """crc32 of ASCII text: bit by bit, eight steps per character."""
    steps = f"list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, {CRC} * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)"
    return f"xor(list_reduce(list_prepend({ONES}::BIGINT, {codes}), lambda c, x: {steps}), {ONES}::BIGINT)"


PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_crc32('conv_id::VARCHAR')} % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
r AS (
  SELECT c.conv_id, pos + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.taken
  UNION ALL
  SELECT c.conv_id, c.taken + pos - c.h + 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         list(sha256(role || chr(1) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
len AS (SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id),
n AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM p JOIN len USING (conv_id) GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
-- A node's smallest member passes all its ancestors.
sums AS (
  SELECT p.path, count_if(low.n_children = 0) AS n_leaves, sum((low.n_convs - 1) * low.bytes) AS saved
  FROM whole low JOIN p ON p.conv_id = low.conv_id AND p.depth <= low.depth GROUP BY p.path)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums ON sums.path = w.path LEFT JOIN n up ON w.depth > 0 AND up.path = w.path[:-2]
"""
