"""SQL of those queries that SQL can express, for DuckDB."""

from __future__ import annotations

from graphloom.plans.orphan_queries import sql_filled, sql_key

_RECORDS = f"""
WITH records AS (
  SELECT 'entities' AS record_table, file_id, {sql_key('name')} AS k, row_id
  FROM entities WHERE file_id IS NOT NULL AND {sql_filled('name')}
  UNION ALL
  SELECT 'relations', file_id, least({sql_key('source')}, {sql_key('target')}) || chr(31) || greatest({sql_key('source')}, {sql_key('target')}), row_id
  FROM relations WHERE file_id IS NOT NULL AND {sql_filled('source')} AND {sql_filled('target')}
), grouped AS (SELECT *, min(row_id) OVER g AS first_id FROM records WINDOW g AS (PARTITION BY record_table, file_id, k))
"""

_EMPTY = "('', 'n/a', 'na', 'n.a', 'n a', 'none', 'null', 'nil', 'nan', 'unknown', 'unk', 'undefined', 'unspecified', 'not available', 'not applicable', 'missing', 'empty', 'tbd', 'tba', 'tbc', 'todo')"


def _filled(c: str) -> str:
    return f"coalesce(lower(regexp_replace({c}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) NOT IN {_EMPTY}, false)"


_MEASURED = f"""
WITH measured AS (
  SELECT e.file_id, {sql_key('name')} AS k, row_id, extracted_at, coalesce(trust_rank, -1) AS trust,
    CAST({_filled('type')} AS INT) + CAST({_filled('description')} AS INT)
    + CAST(coalesce(len(list_filter(source_id, lambda s: {sql_filled('s')})) > 0, false) AS INT) AS complete
  FROM entities e LEFT JOIN extract_runs r USING (run_id) WHERE file_id IS NOT NULL AND {sql_filled('name')}
), best AS (
  SELECT *, max(complete) OVER g AS c, max(extracted_at) OVER g AS a, max(trust) OVER g AS t, min(row_id) OVER g AS first_id,
    count(*) OVER g AS n FROM measured WINDOW g AS (PARTITION BY file_id, k))
"""

_SURVIVORS = f"""
WITH RECURSIVE measured AS (
  SELECT e.file_id, {sql_key('name')} AS k, row_id, coalesce(epoch_us(extracted_at), -4611686018427387904) AS a, coalesce(trust_rank, -1) AS t,
    CASE WHEN {_filled('type')} THEN type END AS ty, CASE WHEN {_filled('description')} THEN description END AS de,
    CASE WHEN coalesce(len(list_filter(source_id, lambda s: {sql_filled('s')})) > 0, false) THEN array_to_string(source_id, ',') END AS so
  FROM entities e LEFT JOIN extract_runs r USING (run_id) WHERE file_id IS NOT NULL AND {sql_filled('name')}
), counted AS (
  SELECT *, CAST(ty IS NOT NULL AS INT) + CAST(de IS NOT NULL AS INT) + CAST(so IS NOT NULL AS INT) AS c,
    min(row_id) OVER g AS first_id, count(*) OVER g AS n FROM measured WINDOW g AS (PARTITION BY file_id, k)
), vec AS (SELECT DISTINCT first_id, c, a, t FROM counted WHERE n > 1),
dom AS (
  SELECT x.first_id, x.c, x.a, x.t, y.c AS yc, y.a AS ya, y.t AS yt FROM vec x JOIN vec y
  ON x.first_id = y.first_id AND y.c >= x.c AND y.a >= x.a AND y.t >= x.t AND (y.c > x.c OR y.a > x.a OR y.t > x.t)
), walk AS (
  SELECT first_id, c, a, t, 1 AS l FROM vec
  UNION SELECT d.first_id, d.c, d.a, d.t, w.l + 1 FROM walk w JOIN dom d ON d.first_id = w.first_id AND d.yc = w.c AND d.ya = w.a AND d.yt = w.t
), layered AS (SELECT first_id, c, a, t, max(l) AS l FROM walk GROUP BY ALL),
placed AS (SELECT * FROM counted JOIN layered USING (first_id, c, a, t))
SELECT first_id, count(*) AS size, first(row_id ORDER BY l, c DESC, a DESC, t DESC, row_id) AS row_id,
  first(ty ORDER BY l, c DESC, a DESC, t DESC, row_id) FILTER (WHERE ty IS NOT NULL) AS type,
  first(de ORDER BY l, c DESC, a DESC, t DESC, row_id) FILTER (WHERE de IS NOT NULL) AS description,
  first(so ORDER BY l, c DESC, a DESC, t DESC, row_id) FILTER (WHERE so IS NOT NULL) AS source_id,
  max(l) AS layers, bool_or(l = 1 AND c = mc AND a = ma AND t = mt) AS ideal
FROM (SELECT *, max(c) OVER g AS mc, max(a) OVER g AS ma, max(t) OVER g AS mt FROM placed WINDOW g AS (PARTITION BY first_id)) GROUP BY first_id"""

_NEAR = """
  SELECT '{t}' AS vector_table, least(id, other) AS id_a, greatest(id, other) AS id_b
  FROM (
    SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r
    FROM {t}_v a JOIN {t}_v b ON a.id <> b.id) WHERE r <= 5"""
_VECTORS = """{t}_v AS (
  SELECT id, min(CAST(vec AS DOUBLE[])) AS v FROM {t}
  WHERE id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY id)"""

SQL = {
    "p8_checks": """
SELECT CAST(spec_id AS BIGINT) AS spec_id, CAST(sum(ceil(size / capacity_tokens)) AS BIGINT) AS parts, CAST(sum(size) AS BIGINT) AS tokens,
  CAST(0 AS BIGINT) AS over, count(*) AS documents, CAST(0 AS BIGINT) AS not_whole, true AS tight
FROM (SELECT octet_length(encode(text)) + 1 AS size FROM documents WHERE text IS NOT NULL), container_specs GROUP BY ALL""",
    "p6_found": "WITH "
    + ", ".join(_VECTORS.format(t=t) for t in ("entity_vectors", "chunk_vectors"))
    + "SELECT DISTINCT * FROM ("
    + " UNION ALL ".join(_NEAR.format(t=t) for t in ("entity_vectors", "chunk_vectors"))
    + ")",
    "p9_found": """
WITH toks AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}]+') AS w, 12 AS n FROM documents
  UNION ALL SELECT 'd', doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]'), 20 FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}]+'), 12 FROM eval_items WHERE lang NOT LIKE 'zh%'
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]'), 20 FROM eval_items WHERE lang LIKE 'zh%'
), grams AS (
  SELECT DISTINCT kind, id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM toks, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS t(i)
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i USING (n, g) WHERE d.kind = 'd' AND i.kind = 'i'""",
    "p2_found": """
SELECT DISTINCT chunk_id FROM chunks c
LEFT JOIN chunk_configs g USING (config_id), (SELECT fixed_size AS d FROM chunk_configs WHERE is_default)
WHERE length(text) > coalesce(g.fixed_size, d)""",
    "p3_found": _RECORDS + "SELECT DISTINCT record_table, first_id, row_id FROM grouped WHERE row_id <> first_id",
    "p3_collapsed": _RECORDS + "SELECT record_table, first_id, count(*) AS copies FROM grouped GROUP BY record_table, file_id, k, first_id",
    "p7_survivors": _SURVIVORS,
    "p7_found": _MEASURED
    + "SELECT first_id, min(row_id) AS row_id FROM best WHERE n > 1 AND complete = c AND extracted_at = a AND trust = t GROUP BY file_id, k, first_id",
}
