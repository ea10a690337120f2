"""The same answers in SQL, for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op7_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, host, text, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d),
pos AS (SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM pos),
twice AS (SELECT rid, t FROM tri GROUP BY rid, t HAVING count(*) > 1),
covered AS (
  SELECT rid, count(DISTINCT j) AS n
  FROM (SELECT rid, i + k AS j FROM tri JOIN twice USING (rid, t), (VALUES (0), (1), (2)) o(k)) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, host, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.rid = w.rid),
f AS (
  SELECT host, count(*) AS n, sum((n_words < 50)::INT) AS short, sum((100 * n_repeat_words > 50 * n_words)::INT) AS repeats,
         sum((10 * n_symbols > n_words)::INT) AS symbols, sum((100 * n_dup_lines > 30 * n_lines)::INT) AS lines
  FROM m GROUP BY host),
r AS (
  SELECT host, n, 'short' AS rule, short AS failed FROM f UNION ALL SELECT host, n, 'repeats', repeats FROM f
  UNION ALL SELECT host, n, 'symbols', symbols FROM f UNION ALL SELECT host, n, 'lines', lines FROM f),
p0 AS (SELECT rule, avg(failed / n) AS mean, coalesce(var_samp(failed / n), 0) AS v FROM r GROUP BY rule),
p AS (
  SELECT rule, mean, CASE WHEN v <= 0 OR mean * (1 - mean) <= 0 THEN 100.0
                          ELSE greatest(2.0, least(100.0, mean * (1 - mean) / v - 1)) END AS weight FROM p0),
s AS (SELECT host, (failed + mean * weight) / (n + weight) AS rate, n + weight AS w FROM r JOIN p USING (rule)),
h AS (SELECT host, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) > 0.5) AS host_rejected FROM s GROUP BY host),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT coalesce(host_rejected, FALSE) AS kept
FROM b LEFT JOIN h ON b.host IS NOT DISTINCT FROM h.host
"""

ORACLE["op12_angular_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE["op13_norm_buckets"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM w GROUP BY rid),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
x AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS x
  FROM tf JOIN wt USING (term) JOIN n USING (rid), c)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY sum(times * x) DESC, doc_id, rid)::INT AS rank, doc_id, sum(times * x)::BIGINT AS score
FROM asked JOIN x USING (term) GROUP BY item_id, text, rid, doc_id HAVING sum(times * x) > 0
QUALIFY rank <= 20
"""
