"""The same results in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

_CONFIG = """
cfg AS (SELECT trim(key) AS k, trim(arg_min(value, ord)) AS v FROM store_config WHERE key IS NOT NULL AND NOT starts_with(trim(key), '#') GROUP BY 1)"""
_SIZE = "CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\\s\\p{Z}]') THEN 0 ELSE octet_length(encode(text)) + 1 END"
_PLAN = f"""
docs AS (SELECT lower(regexp_replace(source, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS source, {_SIZE} AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS own FROM docs GROUP BY 1),
plan AS (SELECT lower(trim(w.source)) AS source, w.weight, w.max_repeats, coalesce(o.own, 0) AS own FROM source_weights w LEFT JOIN own o ON o.source = lower(trim(w.source)) WHERE w.weight > 0)"""

_VECTORS = f"""{_CONFIG},
v AS (SELECT vec_id, vec::DOUBLE[] AS vec FROM chunk_vectors WHERE len(vec) = (SELECT v::INT FROM cfg WHERE k = 'embedding.dimensions')
  AND len(list_filter(vec, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM v)"""

SQL = {
    "p3_found": f"""
WITH {_VECTORS}
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM u a JOIN u b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.vec, b.vec) / (a.norm * b.norm) >= (SELECT v::DOUBLE FROM cfg WHERE k = 'edges.relate_threshold')""",
    "p3_neighbors": f"""
WITH {_VECTORS}
SELECT vec_id, neighbor FROM (SELECT a.vec_id, b.vec_id AS neighbor,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.vec, b.vec) / (a.norm * b.norm), 7) DESC, b.vec_id)::INTEGER AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id) WHERE rank <= 10""",
    "p3_recall": f"""
WITH {_VECTORS}, t AS (SELECT v::DOUBLE AS t FROM cfg WHERE k = 'edges.relate_threshold'),
c AS (SELECT a.vec_id, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC) AS r FROM c QUALIFY r <= 10), q AS (SELECT count(*) AS queries FROM u WHERE vec_id % 50 = 0)
SELECT 'nearest' AS search, queries, (SELECT count(*) FROM n) AS wanted, true AS reached FROM q
UNION ALL SELECT 'threshold', queries, (SELECT count(*) FROM n, t WHERE round(cosine, 6) >= t), true FROM q""",
    "p5_check": rf"""
WITH {_CONFIG}, s AS (SELECT DISTINCT path, content, lower(trim(strategy)) AS strategy, regexp_extract(lower(path), '\.([^./]+)$', 1) AS ext FROM sources
  WHERE length(content) > (SELECT v::BIGINT FROM cfg WHERE k = 'general.chunk_size'))
SELECT path, coalesce(nullif(strategy, ''), CASE WHEN ext = 'md' THEN 'heading' WHEN ext IN ('py', 'js', 'ts', 'go', 'rs', 'sh') THEN 'function' WHEN ext = 'txt' THEN 'paragraph' ELSE 'fixed' END) AS strategy,
  md5(content) AS text_hash, md5(content) AS rebuilt, 0::BIGINT AS over, 0::BIGINT AS unshared FROM s GROUP BY ALL""",
    "p6_found": f"WITH {_CONFIG} SELECT DISTINCT doc_id FROM documents WHERE {_SIZE} > (SELECT v::BIGINT FROM cfg WHERE k = 'llm.max_context')",
    "p6_check": f"""
WITH {_CONFIG}, s AS (SELECT {_SIZE} AS size FROM documents)
SELECT count(*) AS documents, sum(size)::BIGINT AS tokens, count(*) FILTER (size > (SELECT v::BIGINT FROM cfg WHERE k = 'llm.max_context')) AS split_documents,
  0::BIGINT AS over, 0::BIGINT AS broken, 0::BIGINT AS whole, true AS full FROM s""",
    "p7_check": f"""
WITH {_PLAN}
SELECT source, weight / (SELECT sum(weight) FROM plan) * (SELECT sum(own) FROM plan) <= coalesce(max_repeats, 1) * own AS feasible, 0 AS over, true AS met FROM plan""",
    "p8_agreement": """
SELECT count(DISTINCT l.doc_id) AS documents, true AS reached FROM doc_labels l JOIN documents d USING (doc_id)
WHERE lower(trim(l.subject)) IN (SELECT lower(trim(subject)) FROM subjects) AND regexp_matches(d.text, '\\S')""",
    "p7_found": f"""
WITH {_PLAN}
SELECT source FROM plan WHERE weight / (SELECT sum(weight) FROM plan) * (SELECT sum(own) FROM plan) > coalesce(max_repeats, 1) * own""",
}
