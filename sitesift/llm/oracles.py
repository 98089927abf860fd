"""DuckDB SQL for the rows of the queries that SQL can express. Columns that
hold nulls are DOUBLE here: a data frame of nullable longs has that type."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
TEXT = "coalesce(text, '')"

ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH t(t, txt, label, base) AS (VALUES {{templates}}
), ts AS (
  SELECT t, label, base, string_split(txt, ' ') AS seq, list_distinct(string_split(txt, ' ')) AS tset, greatest(32, len(string_split(txt, ' '))) AS stride FROM t
), w AS (SELECT doc_id, {ALNUM_WORDS.format(LOWER.format(TEXT))} AS ws FROM documents
), b AS (
  SELECT doc_id, stride, ws[stride * k + 1:stride * k + 2 * stride] AS bw FROM (
    SELECT doc_id, ws, stride, unnest(generate_series(0, (len(ws) - 1) // stride)) AS k FROM w, (SELECT DISTINCT stride FROM ts) WHERE len(ws) > 0)
), m AS (
  SELECT doc_id, t, label, shared / size AS share FROM (
    SELECT doc_id, t, label, len(list_intersect(tset, bw)) AS shared, len(tset) AS size FROM b JOIN ts USING (stride))
  WHERE 100 * shared >= CASE WHEN size < 20 THEN 100 ELSE 80 END * size
), ml AS (SELECT doc_id, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY doc_id
), p AS (
  SELECT doc_id, i, ws, unnest(generate_series(0, len(ws) - 1)) AS pos FROM (SELECT doc_id, ws, 0 AS i FROM w WHERE len(ws) > 0)
), pl AS (
  SELECT doc_id, pos, label FROM p, ts WHERE base AND ws[pos + 1] = seq[1] AND ws[pos + 1:pos + len(seq)] = seq
), bl AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::DOUBLE AS first_word, last_word::DOUBLE AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN ml USING (doc_id) LEFT JOIN bl USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS.format(LOWER.format(TEXT))} AS ws FROM documents
), b AS (SELECT item_id::VARCHAR AS item_id, {ALNUM_WORDS.format(LOWER.format(TEXT))} AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, s, ws[i + 1:i + s] AS win FROM (
    SELECT item_id, ws, least(13, len(ws)) AS s, unnest(generate_series(0, len(ws) - least(13, len(ws)))) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, s, i, ws[i + 1:i + s] AS win FROM (
    SELECT doc_id, s, ws, unnest(generate_series(0, len(ws) - s)) AS i FROM d, (SELECT DISTINCT s FROM bw) WHERE len(ws) >= s)
), h AS (SELECT doc_id, s, i, item_id FROM dw JOIN bw USING (s, win)
), n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + s - 1)) AS j FROM h) GROUP BY doc_id
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SPACE_WORDS.format(LOWER.format(TEXT))} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), linked AS (SELECT x, y FROM e UNION SELECT y, x FROM e
), reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN linked b ON b.x = r.y
), comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5 = f"""
WITH w AS (
  SELECT doc_id, {TEXT} AS t, {SPACE_WORDS.format(TEXT)} AS ws FROM documents
), a AS (
  SELECT doc_id, t, ws, len(ws) AS n,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CASE WHEN len(ws) < 3 THEN []::VARCHAR[] ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' ')) END AS g FROM w
), g AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM a
), r AS (
  SELECT doc_id, count(DISTINCT j) AS c FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, n::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (n_words > 10000000)::INT)::BIGINT AS failed_bits FROM m
)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits & 63 = 0 AS kept FROM b
"""


OP8 = """
WITH p AS (
  SELECT page_id, url, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), l AS (SELECT payload_digest, max(page_id) AS lead FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < lead THEN 'revisit' ELSE 'response' END AS record_type,
  (CASE WHEN page_id < lead THEN lead END)::DOUBLE AS refers_to, url
FROM p LEFT JOIN l USING (payload_digest)
"""

OP12 = f"""
WITH w AS (
  SELECT doc_id, source, len({SPACE_WORDS.format(TEXT)})::BIGINT AS size,
    (('0x' || substr(md5('0 ' || doc_id || ' ' || {TEXT}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u FROM documents
), n AS (
  SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM w GROUP BY source
), r AS (
  SELECT *, [5, 2, 1][(sid - 1) % 3 + 1]::HUGEINT AS wt, sum(s) OVER () AS total FROM n
), f AS (
  SELECT *, coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS below,
    (sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS free FROM r WINDOW o AS (ORDER BY s / wt, sid)
), c AS (
  SELECT *, bool_and(3 * s * free < wt * (total - below)::HUGEINT) OVER (ORDER BY s / wt, sid) AS capped FROM f
), t AS (
  SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN capped THEN (3 * s)::DOUBLE ELSE (wt * left_over)::DOUBLE / shared::DOUBLE END AS target FROM (
    SELECT *, (total - coalesce(sum(3 * s) FILTER (capped) OVER (), 0))::HUGEINT AS left_over, coalesce(sum(wt) FILTER (NOT capped) OVER (), 1) AS shared FROM c)
), g AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE floor(target / s::DOUBLE)::BIGINT END AS copies FROM t
), p AS (
  SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE target / s::DOUBLE - copies END AS p, target - (copies * s)::DOUBLE AS need FROM g
), d AS (
  SELECT w.doc_id, w.size, p.sid, p.s::BIGINT AS source_size, p.target, p.copies, p.need,
    CASE WHEN p.p > 0 AND size > 0 THEN (u / (1 - u)) / (p.p / (1 - p.p)) END AS q FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source
), e AS (
  SELECT *, row_number() OVER o AS rn, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM d WINDOW o AS (PARTITION BY sid ORDER BY q IS NULL, q, doc_id, size)
), a AS (SELECT *, q IS NOT NULL AND upto <= need AS drawn FROM e
), l AS (
  SELECT sid, need - upto AS gap, row_number() OVER (PARTITION BY sid ORDER BY rn DESC) - 1 AS k FROM a WHERE drawn
), lk AS (
  SELECT sid, gap, k FROM l WHERE k <= 8 UNION ALL
  SELECT sid, need, n FROM (SELECT p.sid, p.need, coalesce(c, 0) AS n FROM p LEFT JOIN (SELECT sid, count(*) AS c FROM l GROUP BY sid) USING (sid)) WHERE n <= 8
), b AS (
  SELECT a.sid, a.rn, lk.k, lk.gap, abs(a.size - lk.gap) AS off FROM a JOIN lk USING (sid) WHERE NOT drawn AND q IS NOT NULL
), best AS (
  SELECT b.* FROM b JOIN (SELECT sid, gap AS first_gap FROM lk WHERE k = 0) USING (sid) WHERE off < first_gap
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY off, k, rn) = 1
), o AS (
  SELECT a.doc_id, a.size, a.source_size, a.target,
    (a.copies + ((drawn AND (best.sid IS NULL OR upto <= need - best.gap + 0.5)) OR coalesce(a.rn = best.rn, FALSE))::INT)::BIGINT AS copies
  FROM a LEFT JOIN best ON a.sid = best.sid
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM o
"""


def _op3() -> str:
    from .license_join import PHRASES, TEMPLATES
    rows = [f"({k}, '{text}', '{label}', {k < len(PHRASES)})" for k, (text, label) in enumerate(PHRASES + TEMPLATES)]
    return OP3.replace("{templates}", ", ".join(rows))


ORACLE: dict[str, str] = {"op3_license_scans": _op3(), "op7_benchmark_decontamination": OP7, "op5_quality_rules": OP5, "op8_warc": OP8, "op9_minhash_near_dedup": OP9,
                          "op12_pareto_mixing": OP12}
