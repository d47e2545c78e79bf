"""DuckDB counterparts of the queries of this part that SQL can express."""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), judged AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT j.page_id, j.host, j.path, max_by(h || p, length(h || p)) AS rule,
  coalesce(max_by(v, length(h || p)), 'allow') AS verdict
FROM judged j
LEFT JOIN rules ON (j.host = h OR ends_with(j.host, '.' || h)) AND starts_with(j.path, p)
GROUP BY ALL
"""

TOP_K = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT)
      AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), placed AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""

LLM_ORACLES = {"op6_url_filters": URL_FILTERS, "op11_exhaustive_top_k": TOP_K}
