"""The queries of this subpackage in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, win.i + j.j AS i FROM win JOIN f ON win.k = f.k, range(13) j(j) WHERE f.least < win.doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT t.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

JACCARD_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, d.v FROM r JOIN d ON r.b = d.u)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id"""

EXACT_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


def url_filter(rules: list[tuple[str, str]], damping: float = 0.85, margin: float = 0.5, least: float = 1e-3, rounds: int = 150) -> str:
    """Trust and distrust are sums of what moves in each round; after so many rounds what is left is far below least."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = "".join(f" WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in ordered)
    verdict = "".join(f" WHEN rule = '{r}' THEN '{v}'" for v, r in ordered)
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    link = r"(?i)href\s*=\s*[\"'']?(?:https?:)?//([^/?#\"''\s>]+)"
    return rf"""WITH RECURSIVE p0 AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path FROM pages),
p1 AS (SELECT *, CASE{fits} END AS rule FROM p0), p AS (SELECT *, CASE{verdict} END AS ruled FROM p1),
h AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS good, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS bad FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY ALL),
b AS (SELECT 't' AS kind, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
w AS (SELECT kind, src, dst, n / CAST(sum(n) OVER (PARTITION BY kind, src) AS DOUBLE) AS part FROM b),
m(round, kind, host, score) AS (SELECT 0, 't', host, CAST(good AS DOUBLE) FROM h WHERE good > 0 UNION ALL SELECT 0, 'd', host, CAST(bad AS DOUBLE) FROM h WHERE bad > 0
  UNION ALL SELECT m.round + 1, m.kind, w.dst, sum({damping} * m.score * w.part) FROM m JOIN w ON w.kind = m.kind AND w.src = m.host WHERE m.round < {rounds} GROUP BY m.round, m.kind, w.dst),
s AS (SELECT host, sum(CASE WHEN kind = 't' THEN score ELSE 0 END) AS t, sum(CASE WHEN kind = 'd' THEN score ELSE 0 END) AS d FROM m GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d, 0) - coalesce(t, 0) > CASE WHEN coalesce(good + bad, 0) > 0 THEN {margin} ELSE {least} END THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN h ON h.host = p.host LEFT JOIN s ON s.host = p.host"""


#: The base columns of op10; crc32 is folded over the digits of an id with a table of 256 remainders.
LM_BASE = rf"""WITH ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, xor(CAST(4294967295 AS BIGINT), list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, y: xor(c // 256, ct.t[xor(c, y) % 256 + 1]))) % 7 = 2 AS held_out,
  list_transform(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}'), lambda x: 'w' || x) || ['end'] AS ws FROM documents, ct),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), z AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(z.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(z.n + z.v + 1 AS DOUBLE))), 4) AS base_score
FROM t LEFT JOIN c ON t.w = c.w, z GROUP BY doc_id, held_out"""
