"""DuckDB SQL for the queries whose rows SQL can give."""

from __future__ import annotations


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api")).removesuffix(_any_case("api")) + _any_case("api") + "_?" + _any_case("key")
_PATTERNS = (f"""({_KEYS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{24,}")
_GOOD = (
    f"len(regexp_extract(value, '{_PATTERNS[0]}', 2)) >= 6",
    "true",
    "true",
    "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9].*[0-9]')",
)
_HITS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT row, doc_id, owner, {k} AS kind, i, hits[i] AS value, CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS BIGINT) AS low FROM (SELECT row, doc_id, owner, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM d), unnest(range(1, len(hits) + 1)) t(i)) WHERE {good}"
    for k, (p, good) in enumerate(zip(_PATTERNS, _GOOD))
)

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
h AS (SELECT *, low + length(value) AS high, sha256(CASE WHEN kind = 0 THEN regexp_extract(value, '{_PATTERNS[0]}', 2) ELSE value END) AS hash FROM ({_HITS})),
o AS (SELECT hash, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doc_id, -row)) AS repositories FROM h GROUP BY 1),
j AS (SELECT h.*, owners <= 2 AND repositories <= 16 AS live, repositories FROM h JOIN o USING (hash) WHERE kind < 3 OR (owners <= 2 AND repositories <= 16 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.row = h.row AND b.kind < 3 AND b.low < h.high AND b.high > h.low))),
t AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || low || ':' || high AS told FROM j)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256(coalesce(string_agg(told, ',' ORDER BY low, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY low, kind), '') AS spans,
 count(*) FILTER (kind = 3) AS n_opaque, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, CAST(coalesce(max(repositories), 0) AS BIGINT) AS max_repositories
FROM d LEFT JOIN t USING (row) GROUP BY d.row, d.doc_id
"""

#: Every window of 200 bytes by its MD5, as hexadecimal text; quick on small tables alone.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, greatest(n - 199, 0))) t(i)),
k AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
s AS (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT row, min(i) AS low, max(i) + 200 AS high FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS g FROM s) GROUP BY row, g),
e AS (SELECT row, low, high, coalesce(lag(high) OVER (PARTITION BY row ORDER BY low), 0) AS before FROM g),
r AS (SELECT e.row, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || any_value(substr(h, 2 * m + 1)) AS kept FROM e JOIN d USING (row) JOIN (SELECT row, max(high) AS m FROM g GROUP BY row) USING (row) GROUP BY e.row)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (row)
"""

JACCARD = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, o = a.n AND o = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
c(x, y) AS (SELECT x, y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
r AS (SELECT x, min(y) AS y FROM c GROUP BY 1),
k AS (SELECT x, count(*) AS links, min(y) FILTER (same) AS y FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id, coalesce(links, 0) AS n_links, least(d.doc_id, coalesce(k.y, d.doc_id)) AS class_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""

#: The test pages hold their text in one article element; entities are those that they use.
PAGES = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
 SELECT page_id, url, array_to_string(list_filter([trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) FOR b IN string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>')], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM pages)
"""

ORACLES = {"op2_suffixes": REPEATS, "op4_secrets": SECRETS, "op5_jaccard": JACCARD, "op10_html": PAGES}
