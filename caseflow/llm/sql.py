"""DuckDB oracles of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op9_digest_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ORACLE["op3_norm_bucketed_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op5_jaccard_metric_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
x AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS m FROM w),
u AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, i, m, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
                                   lead(word, 3) OVER o, lead(word, 4) OVER o) AS g
    FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE i <= greatest(m - 4, 1)),
n AS (
  SELECT w.doc_id, count(u.g) AS n FROM w LEFT JOIN u ON u.doc_id = w.doc_id GROUP BY w.doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (
  SELECT doc_id, doc_id AS t FROM n
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.t = l.a)
SELECT r.doc_id, n.n AS n_shingles, min(t) AS component_id
FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""

# crc32 of the decimal id, bit by bit
ORACLE["op11_ternary_prefix_trie"] = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
      lambda x, y: list_reduce(
        list_prepend(xor(x, y), list_transform(range(8), lambda i: 0::BIGINT)),
        lambda a, b: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM ids),
reb AS (
  SELECT h.c, o.i AS p, o.role, o.text FROM h JOIN own o ON o.c = h.base AND o.i <= h.h
  UNION ALL
  SELECT h.c, 1000000 + o.i, o.role, o.text FROM h JOIN own o ON o.c = h.c AND o.i > h.h),
pre AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS bytes,
         md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER (
           PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)) AS k
  FROM reb WINDOW w AS (PARTITION BY c ORDER BY p)),
path AS (
  SELECT c, d, k, bytes, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY d) AS up,
         count(*) OVER (PARTITION BY c) = d AS ends FROM pre
  UNION ALL
  SELECT c, 0, 'root', 0, NULL, NOT EXISTS (SELECT 1 FROM reb WHERE reb.c = ids.c) FROM ids),
node AS (
  SELECT k, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM path GROUP BY k),
child AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT a.k, sum(CASE WHEN child.up IS NULL THEN 1 ELSE 0 END) AS leaves,
         sum(CASE WHEN x.d = 0 THEN 0 ELSE (x.n - 1) * x.bytes END) AS saved
  FROM node x LEFT JOIN child ON child.up = x.k JOIN path a ON a.c = x.c AND a.d <= x.d GROUP BY a.k)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, up.c AS parent_conv_id, node.n::BIGINT AS n_convs,
       coalesce(child.n, 0)::BIGINT AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
       node.ends_sha256
FROM node JOIN sums ON sums.k = node.k LEFT JOIN child ON child.up = node.k LEFT JOIN node up ON up.k = node.up
"""
