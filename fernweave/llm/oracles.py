"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Base32 of a SHA-1: eight groups of 20 bits, four letters each.
ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
d AS (
  SELECT page_id, body, list_aggregate(list_transform(range(8), lambda g:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS INT) >> CAST(s AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS b32
  FROM p)
SELECT d.page_id, CAST(octet_length(encode(d.body)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d JOIN f USING (body)
"""

#: Targets by three rounds of resharing (a round caps at least one of the 20 sources' weights, or is the last), written out as a recursion.
ORACLES["op6_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, [3.0, 1.0, 2.0][CAST(i % 3 + 1 AS INT)]::DOUBLE AS w, 2.0::DOUBLE * n AS cap FROM s),
r(k, source, n, w, cap, fixed) AS (
  SELECT 0, source, n, w, cap, FALSE FROM w
  UNION ALL
  SELECT k + 1, source, n, w, cap, fixed OR
    (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) FILTER (fixed) OVER (), 0)) * w / (sum(w) FILTER (NOT fixed) OVER ()) > cap
  FROM r WHERE k < 25),
t AS (
  SELECT source, n, CASE WHEN fixed THEN cap ELSE
    (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) FILTER (fixed) OVER (), 0)) * w / (sum(w) FILTER (NOT fixed) OVER ()) END AS target
  FROM r WHERE k = 25),
e AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target, d.source,
    CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS epochs,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(d.text))), 1, 13)) AS BIGINT)::DOUBLE + 1.0) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * ((length(d.text) - length(translate(d.text, '#*$%&|<>!', '')))::DOUBLE / greatest(length(d.text), 1)::DOUBLE)) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - epochs * source_size AS budget, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND upto - size < budget AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

ORACLES["op2_decontamination"] = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS n, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

#: A run goes forward from a sentence, or backward, until it has two sentences and 16 words.
ORACLES["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
    list_filter(coalesce(regexp_extract_all(text, '(?s)[\x20\x09-\x0D]*.*?(?:[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|\z)'), []), lambda x: x <> '') AS p FROM documents),
q AS (SELECT rid, doc_id, i, p[i] AS raw, trim(regexp_replace(p[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS q FROM (SELECT rid, doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d)),
s AS (SELECT *, sum(len(string_split(q, ' '))) OVER (PARTITION BY rid ORDER BY i) AS upto, len(string_split(q, ' ')) AS w FROM q),
runs AS (
  SELECT x.rid, x.doc_id, x.i, min(y.i) AS j FROM s x JOIN s y ON x.rid = y.rid AND y.i > x.i AND y.upto - x.upto + x.w >= 16 GROUP BY ALL
  UNION SELECT y.rid, y.doc_id, max(x.i) AS i, y.i AS j FROM s x JOIN s y ON x.rid = y.rid AND y.i > x.i AND y.upto - x.upto + x.w >= 16 GROUP BY y.rid, y.doc_id, y.i
  UNION SELECT rid, doc_id, i, i AS j FROM s WHERE w >= 30),
r AS (SELECT r.rid, r.doc_id, r.i, r.j, string_agg(s.q, ' ' ORDER BY s.i) AS t FROM runs r JOIN s ON r.rid = s.rid AND s.i BETWEEN r.i AND r.j GROUP BY r.rid, r.doc_id, r.i, r.j),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, rid, i, j) AS place FROM r),
g AS (SELECT DISTINCT rid, unnest(range(i, j + 1)) AS i FROM f WHERE place > 1),
o AS (
  SELECT s.rid, count(*) AS n_sentences, count(g.i) AS n_removed, coalesce(string_agg(raw, '' ORDER BY s.i) FILTER (g.i IS NULL), '') AS text
  FROM s LEFT JOIN g ON s.rid = g.rid AND s.i = g.i GROUP BY s.rid)
SELECT d.doc_id, CAST(coalesce(o.n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN o.n_removed > 0 THEN o.text ELSE d.text END AS text, sha256(CASE WHEN o.n_removed > 0 THEN o.text ELSE coalesce(d.text, '') END) AS text_sha256
FROM d LEFT JOIN o USING (rid)
"""

ORACLES["op10_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (
  SELECT a.rid AS x, b.rid AS y FROM s a JOIN s b ON a.t = b.t AND a.rid != b.rid JOIN n p ON p.rid = a.rid JOIN n q ON q.rid = b.rid
  GROUP BY a.rid, b.rid, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def _op5(rounds: int) -> str:
    """The propagation written out, a table a round."""
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"""f{i} AS MATERIALIZED (SELECT m.kind, m.dst AS host, sum(r.mass * m.share * 0.85::DOUBLE) AS flow FROM moves m JOIN r{i - 1} r ON r.kind = m.kind AND r.host = m.src GROUP BY ALL),
r{i} AS MATERIALIZED (SELECT coalesce(s.kind, f.kind) AS kind, coalesce(s.host, f.host) AS host, coalesce(s.seed * (1 - coalesce((SELECT sum(flow) FROM f{i} x WHERE x.kind = s.kind), 0)), 0) + coalesce(f.flow, 0) AS mass FROM seeds s FULL JOIN f{i} f ON s.kind = f.kind AND s.host = f.host)""")
    return r"""
WITH u AS (SELECT page_id, html, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id, html, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT arg_max(verdict, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS by_rule
  FROM h),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM p GROUP BY host),
seeds AS MATERIALIZED (SELECT 0 AS kind, host, a::DOUBLE / (SELECT sum(a) FROM hosts) AS seed FROM hosts WHERE a > 0 UNION ALL SELECT 1, host, b::DOUBLE / (SELECT sum(b) FROM hosts) FROM hosts WHERE b > 0),
l AS (SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1), lambda x: regexp_extract(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))) AS d FROM p WHERE html IS NOT NULL),
e AS (SELECT src, CASE WHEN d = '' THEN src ELSE translate(d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS dst, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
two_way AS (SELECT 0 AS kind, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
moves AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM two_way),
r0 AS (SELECT kind, host, seed AS mass FROM seeds),
""" + ",\n".join(steps) + f""",
v AS (SELECT hosts.host, coalesce(sum(mass) FILTER (kind = 1), 0) AS bad, coalesce(sum(mass) FILTER (kind = 0), 0) AS good, any_value(n)::DOUBLE / (SELECT sum(n) FROM hosts) AS share FROM hosts LEFT JOIN r{rounds} r ON r.host = hosts.host GROUP BY hosts.host)
SELECT page_id, p.host, path, rule, coalesce(by_rule, CASE WHEN round(bad, 12) > round(good, 12) AND round(bad, 12) > round(2.0 * share, 12) THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN v ON p.host = v.host
"""


ORACLES["op5_url_filters"] = _op5(8)
