"""DuckDB twins of the queries of this subpackage."""

SQL: dict[str, str] = {}

SQL["op1_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
repeats AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2)
  GROUP BY rid),
ls AS (
  SELECT rid, host, text, line, lower(regexp_replace(trim(line, E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)),
held AS (
  SELECT *, len(regexp_extract_all(norm, '[^ ]+')) AS words FROM ls WHERE norm <> ''),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM held GROUP BY rid),
counts AS (SELECT host, norm, count(DISTINCT text) AS n FROM held GROUP BY host, norm),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM held GROUP BY host),
lost AS (
  SELECT rid, sum(words) AS n
  FROM held JOIN counts USING (host, norm) JOIN hosts USING (host)
  WHERE counts.n > 20 AND counts.n > hosts.texts * 0.01
  GROUP BY rid),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (lost_words > 0 AND (n_words - lost_words < 50
                                                       OR n_words - lost_words < n_words * 0.5)) AS kept
FROM b
"""

# {documents} is a table with doc_id, text and source.
MIXTURE = r"""
rows_ AS (
  SELECT doc_id, coalesce(source, 'NULL') AS source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM {documents}),
placed_ AS (SELECT * FROM rows_ WHERE n_tokens > 0),
src AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS documents FROM placed_ GROUP BY source),
tot AS (SELECT sum(tokens)::BIGINT AS t FROM src),
ps AS (SELECT list(tokens / CAST(t AS DOUBLE) ORDER BY source) AS ps, 0.97 * ln(count(*)) AS target, count(*) AS n
       FROM src, tot),
halving AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS rlo, CAST(1 AS DOUBLE) AS rhi
  UNION ALL
  SELECT i + 1,
         CASE WHEN ln(z) - m * l / z >= target THEN m ELSE lo END, CASE WHEN ln(z) - m * l / z >= target THEN hi ELSE m END,
         CASE WHEN k / rz > 4.0 THEN r ELSE rlo END, CASE WHEN k / rz > 4.0 THEN rhi ELSE r END
  FROM (SELECT h.*, target, (lo + hi) / 2 AS m, (rlo + rhi) / 2 AS r,
               list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS z,
               list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) AS l,
               list_sum(list_transform(ps, lambda p: pow(p, (rlo + rhi) / 2))) AS rz,
               list_max(list_transform(ps, lambda p: pow(p, (rlo + rhi) / 2 - 1))) AS k
        FROM halving h, ps WHERE i < 32)),
ends AS (
  SELECT -list_sum(list_transform(ps, lambda p: p * ln(p))) >= target AS flat,
         list_max(list_transform(ps, lambda p: 1 / p)) / n <= 4.0 AS seldom, n, ps FROM ps),
alpha AS (
  SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(CASE WHEN flat THEN 1.0 ELSE lo END,
                                                CASE WHEN seldom THEN 0.0 ELSE rhi END) END AS a, ps
  FROM halving, ends WHERE i = 32),
weights AS (
  SELECT source, tokens, documents, t // 1000000 AS b1, t % 1000000 AS b0,
         CAST(floor(pow(tokens / CAST(t AS DOUBLE), a) / list_sum(list_transform(ps, lambda p: pow(p, a))) * 1e9 + 0.5)
              AS BIGINT) AS ppb
  FROM src, tot, alpha),
quotas AS (SELECT *, CAST(b1 * ppb // 1000 + b0 * ppb // 1000000000 AS BIGINT) AS quota FROM weights),
plan_ AS (SELECT greatest(1, (sum(quota)::BIGINT + 262143) // 262144) AS blocks FROM quotas),
passes AS (
  SELECT *, CAST('0x' || substr(md5('17:' || copy || ':' || name), 1, 13) AS BIGINT) AS h
  FROM (SELECT p.*, tokens, quota, unnest(generate_series(0, quota // tokens)) AS copy
        FROM placed_ p JOIN quotas USING (source))),
ended AS (
  SELECT *, copy * tokens + sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY h, name, n_tokens
                                                ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM passes),
blocked AS (
  SELECT e.*, CAST(least(blocks - 1, floor(CAST(stop - n_tokens AS DOUBLE) * CAST(blocks AS DOUBLE) / quota)) AS BIGINT)
              AS block,
         CAST('0x' || substr(md5('17:block:' || copy || ':' || name), 1, 13) AS BIGINT) AS spot
  FROM ended e, plan_ WHERE stop <= quota)
SELECT doc_id, source, copy, block,
       row_number() OVER (PARTITION BY block ORDER BY spot, name, copy, n_tokens, stop) AS position, n_tokens
FROM blocked
"""

SQL["op6_mixture"] = "WITH RECURSIVE" + MIXTURE.replace("{documents}", "documents")

SQL["op12_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf
       FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (
  SELECT item_id, row_number() OVER () AS uid,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT uid, item_id, term, count(*) AS times FROM (SELECT uid, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM df, totals),
scored AS (
  SELECT uid, item_id, rid, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term), totals
  GROUP BY uid, item_id, rid, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
