"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM s
), v AS (
  SELECT *, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE turn WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS from_w,
    CASE turn WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS to_w, 2 * source_size AS room FROM w
), p AS (
  SELECT a.source, coalesce(sum(b.room), 0) AS room_before, coalesce(sum(b.weight), 0) AS weight_before
  FROM v a LEFT JOIN v b ON b.room::DOUBLE / b.weight < a.room::DOUBLE / a.weight OR (b.room::DOUBLE / b.weight = a.room::DOUBLE / a.weight AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))
  GROUP BY a.source
), l AS (
  SELECT min((1.5::DOUBLE * (SELECT sum(source_size) FROM v) - p.room_before) / ((SELECT sum(weight) FROM v) - p.weight_before)) AS level_none,
    min_by(struct_pack(r := p.room_before, w := (SELECT sum(weight) FROM v) - p.weight_before), v.room::DOUBLE / v.weight) FILTER (WHERE v.weight * (1.5::DOUBLE * (SELECT sum(source_size) FROM v) - p.room_before) < v.room * ((SELECT sum(weight) FROM v) - p.weight_before)) AS at,
    (SELECT 1.5::DOUBLE * sum(source_size) FROM v) AS total
  FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source
), t AS (
  SELECT v.source, v.source_size, from_w, to_w,
    CASE WHEN l.at IS NULL OR v.weight * (l.total - l.at.r) / l.at.w >= v.room THEN v.room::DOUBLE ELSE v.weight * (l.total - l.at.r) / l.at.w END AS target
  FROM v, l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.from_w, t.to_w,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), CAST(d.size AS VARCHAR))), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS one, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS two FROM o
)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN round(CASE WHEN to_w = from_w THEN least(1.0::DOUBLE, (start + one / 2) / target)
    ELSE 2 * (least(1.0::DOUBLE, (start + one / 2) / target) * (from_w + to_w) / 2) / (from_w + sqrt(from_w * from_w + 2 * (to_w - from_w) * (least(1.0::DOUBLE, (start + one / 2) / target) * (from_w + to_w) / 2))) END, 9) END AS first_position
FROM k
"""

TOPK = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(m.good, 0) AS good, coalesce(m.bad, 0) AS bad, [
    len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN m ON m.doc_id = w.doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL
), l AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS steps FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, steps, k.i AS step, steps[k.i] AS filter, sum(n) AS total,
    coalesce(sum(n) FILTER (WHERE place = k.i), 0) AS removed, coalesce(sum(n) FILTER (WHERE place IS NULL OR place > k.i), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails[steps[k.i]] AND place < k.i), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails[steps[k.i]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS alone, coalesce(sum(good) FILTER (WHERE place = k.i), 0) AS good, coalesce(sum(bad) FILTER (WHERE place = k.i), 0) AS bad
  FROM (SELECT *, list_position(list_transform(steps, lambda x: fails[x]), true) AS place FROM g, o) x, l k GROUP BY ALL
)
SELECT part, list_aggregate(list_transform(steps, lambda x: chr(CAST(64 + x AS INTEGER))), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails, CAST(good AS BIGINT) AS good_lost, CAST(bad AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM s
"""

TRIE = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n_bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 31)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, o.role, o.text, o.n_bytes, 0 AS side, o.pos FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.role, o.text, o.n_bytes, 1, o.pos FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), p AS (
  SELECT conv_id, n_bytes, row_number() OVER w AS depth, md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, pos)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), m AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM p
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node
), k AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.node) AS n_children FROM n
), u AS (
  SELECT DISTINCT a.node, b.node AS below FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), t AS (
  SELECT u.node, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes) AS saved_tokens FROM u JOIN k b ON b.node = u.below GROUP BY 1
)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256 FROM k JOIN t USING (node) LEFT JOIN k q ON q.node = k.parent
"""

WARC = """
WITH h AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM h
), d AS (
  SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(hex, CAST(5 * j + 1 AS BIGINT), 5) AS INTEGER)) AS fifths FROM m
)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(flatten(list_transform(fifths, lambda x: [x >> 15, x >> 10 & 31, x >> 5 & 31, x & 31])), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS checked FROM d
"""

ORACLES = {"op5_warc": WARC, "op9_mixing": MIXING, "op7_topk": TOPK, "op12_filter_audit": AUDIT, "op13_conversation_trie": TRIE}
