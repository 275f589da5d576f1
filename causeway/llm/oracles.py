"""DuckDB SQL for the queries that it can express: another way to the same rows."""

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"

OP3 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM s),
o AS (SELECT *, sum(3 * source_size) OVER a - 3 * source_size AS closed, sum(w) OVER b AS open_w, (SELECT sum(source_size) FROM w) AS total FROM w
 WINDOW a AS (ORDER BY 3.0 * source_size / w, source ROWS UNBOUNDED PRECEDING), b AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT (total - closed) / CAST(open_w AS DOUBLE) AS level FROM o WHERE 3 * source_size >= (total - closed) / CAST(open_w AS DOUBLE) * w ORDER BY 3.0 * source_size / w, source LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < level * w THEN 3.0::DOUBLE * source_size ELSE level * w END AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT g.*, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto, target - whole * source_size AS budget FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
k AS (SELECT source, h FROM c WHERE budget > 0 AND (upto <= budget OR (upto - words <= budget AND upto - budget < budget - (upto - words))))
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.whole + CAST(k.h IS NOT NULL AS INTEGER)) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(gram) ORDER BY doc_id, pos) AS nth FROM g WHERE n = 20),
m AS (SELECT u.doc_id, u.pos, u.word, max(CASE WHEN r.nth > 1 THEN u.pos END) OVER (PARTITION BY u.doc_id ORDER BY u.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.pos = r.pos)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count_if(m.gone) AS n_removed, sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.w
"""

ORACLES = {"op3_source_mix": OP3, "op4_substring_dedup": OP4}
