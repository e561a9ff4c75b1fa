"""The core's results in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_BLANK = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
_EDGES = rf"""
e AS (SELECT seq, source, target, regexp_replace(lower(regexp_replace(etype, {_BLANK}, '', 'g')), '[-\s\p{{Z}}]', '_', 'g') AS etype, created_at FROM edges
  WHERE regexp_matches(source, '[^\s\p{{Z}}]') AND regexp_matches(target, '[^\s\p{{Z}}]') AND regexp_matches(etype, '[^\s\p{{Z}}]') AND NOT starts_with(source, '#'))"""
_ORPHANS = f"""
WITH {_EDGES},
ends AS (SELECT seq, etype, created_at, 'source' AS side, source AS path FROM e WHERE etype <> 'retrieved'
  UNION ALL SELECT seq, etype, created_at, 'target', target FROM e),
rec AS (SELECT path, written_at AS born, deleted_at AS died FROM chunks UNION ALL SELECT path, scanned_at, removed_at FROM sources
  UNION ALL SELECT path, written_at, deleted_at FROM collections),
per AS (SELECT path, count(*) FILTER (died IS NULL) AS live, min(born) AS first FROM rec GROUP BY path),
o AS (SELECT ends.*, CASE WHEN per.path IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first > created_at THEN 'late' END AS reason
  FROM ends LEFT JOIN per USING (path))"""
SQL["p1_found"] = _ORPHANS + "SELECT DISTINCT seq, side, reason FROM o WHERE reason IS NOT NULL"
SQL["p1_report"] = _ORPHANS + "SELECT etype, side, strftime(created_at, '%Y-%m') AS month, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY ALL"

_WALK = f"""
WITH RECURSIVE {_EDGES},
p AS (SELECT source AS node, arg_min(target, seq) AS parent FROM e WHERE etype IN ('chunked_from', 'derived_via', 'derived_from', 'synthesizes') GROUP BY source),
w AS (SELECT node, parent AS cur, [node] AS seen FROM p
  UNION ALL SELECT w.node, p.parent, list_append(w.seen, w.cur) FROM w JOIN p ON p.node = w.cur WHERE NOT list_contains(w.seen, w.cur)),
ended AS (SELECT node, arg_max(cur, len(seen)) AS cur, max(len(seen)) AS steps, arg_max(seen, len(seen)) AS seen FROM w GROUP BY node),
found AS (SELECT node, CASE WHEN list_contains(seen, cur) THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root,
  CASE WHEN list_contains(seen, cur) THEN -1 ELSE steps END::INTEGER AS depth, CASE WHEN list_contains(seen, cur) THEN NULL ELSE list_append(seen, cur) END AS up FROM ended)"""
SQL["p2_found"] = _WALK + "SELECT node, root, depth FROM found"
SQL["p2_paths"] = _WALK + """SELECT node, array_to_string(list_reverse(up), ' > ') AS path FROM found WHERE up IS NOT NULL
UNION ALL SELECT DISTINCT root, root FROM found WHERE up IS NOT NULL"""
SQL["p2_descendants"] = _WALK + """SELECT up[i + 1] AS ancestor, node, i::INTEGER AS distance FROM found, unnest(range(1, len(up))) AS r(i) WHERE up IS NOT NULL"""

SQL["p2_tree"] = (
    _WALK
    + """,
ways AS (SELECT node, root, depth, list_reverse(up) AS way FROM found WHERE up IS NOT NULL UNION ALL SELECT DISTINCT root, root, 0, [root] FROM found WHERE up IS NOT NULL),
below AS (SELECT above, count(*) AS n FROM (SELECT unnest(list_slice(way, 1, len(way) - 1)) AS above FROM ways) GROUP BY 1)
SELECT w.node, p.parent, w.root, w.depth, row_number() OVER (ORDER BY way) - 1 AS pre, 1 + coalesce(n, 0) AS size, false AS cyclic
FROM ways w LEFT JOIN p ON p.node = w.node LEFT JOIN below ON above = w.node
UNION ALL SELECT f.node, p.parent, f.root, f.depth, NULL, NULL, true FROM found f JOIN p USING (node) WHERE up IS NULL"""
)
_PART, _SUPPLIER = "CASE WHEN l_linenumber % 3 <> 1 THEN l_partkey END", "CASE WHEN l_linenumber % 4 <> 2 THEN l_suppkey END"
_REASON = "CASE WHEN n IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first > l_shipdate THEN 'late' END"
_STATE = "count(*) AS n, count(*) FILTER (died IS NULL) AS live, min(born) AS first FROM rec WHERE"
SQL["p1_keys"] = f"""
WITH refs AS (SELECT l_orderkey, l_linenumber, l_shipdate, {_PART} AS part, {_SUPPLIER} AS supplier FROM lineitem),
rec AS (SELECT l_partkey AS part, CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS supplier, l_shipdate AS born, CASE WHEN l_tax > 0.05 THEN l_shipdate END AS died FROM lineitem WHERE l_quantity > 25),
b AS (SELECT part, supplier, {_STATE} part IS NOT NULL AND supplier IS NOT NULL GROUP BY ALL),
q AS (SELECT part, {_STATE} part IS NOT NULL GROUP BY ALL), s AS (SELECT supplier, {_STATE} supplier IS NOT NULL GROUP BY ALL),
q0 AS (SELECT part, {_STATE} part IS NOT NULL AND supplier IS NULL GROUP BY ALL), s0 AS (SELECT supplier, {_STATE} supplier IS NOT NULL AND part IS NULL GROUP BY ALL),
z AS (SELECT nullif(count(*), 0) AS n, count(*) FILTER (died IS NULL) AS live, min(born) AS first FROM rec WHERE part IS NULL AND supplier IS NULL),
whole AS (SELECT refs.*, {_REASON} AS reason FROM refs LEFT JOIN b USING (part, supplier) WHERE refs.part IS NOT NULL AND refs.supplier IS NOT NULL),
o AS (SELECT unnest(['simple', 'partial', 'full', 'same']) AS match, * FROM whole
UNION ALL SELECT 'full', *, 'partial' FROM refs WHERE (part IS NULL) <> (supplier IS NULL)
UNION ALL SELECT 'partial', refs.*, {_REASON} FROM refs LEFT JOIN q USING (part) WHERE refs.supplier IS NULL AND refs.part IS NOT NULL
UNION ALL SELECT 'partial', refs.*, {_REASON} FROM refs LEFT JOIN s USING (supplier) WHERE refs.part IS NULL AND refs.supplier IS NOT NULL
UNION ALL SELECT 'same', refs.*, {_REASON} FROM refs LEFT JOIN q0 USING (part) WHERE refs.supplier IS NULL AND refs.part IS NOT NULL
UNION ALL SELECT 'same', refs.*, {_REASON} FROM refs LEFT JOIN s0 USING (supplier) WHERE refs.part IS NULL AND refs.supplier IS NOT NULL
UNION ALL SELECT 'same', refs.*, {_REASON} FROM refs, z WHERE refs.part IS NULL AND refs.supplier IS NULL)
SELECT match, l_orderkey, l_linenumber, part, supplier, reason FROM o WHERE reason IS NOT NULL"""

# the store's chunks: the latest version of each path, if it is not deleted
_CORPUS = r"""
corpus AS (SELECT path, coalesce(domain, CASE WHEN len(string_split(path, '/')) >= 3 THEN split_part(path, '/', 1) ELSE '' END) AS domain, content AS body, kind, stale, has_provenance, written_at FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY written_at DESC NULLS LAST, content DESC NULLS LAST, deleted_at DESC NULLS LAST, domain DESC NULLS LAST, stale DESC NULLS LAST) AS v
  FROM chunks WHERE path IS NOT NULL) WHERE v = 1 AND deleted_at IS NULL),
docs AS (SELECT path, domain, body, kind, stale, length(lower(body)) AS dl FROM corpus WHERE regexp_matches(body, '[^\s\p{Z}]'))"""


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x1c-\x1f\x85]', '', 'g'), '[\s\p{{Z}}\x1c-\x1f\x85]+'), lambda w: length(w) >= 2)"


_POSTINGS = f"""{_CORPUS},
postings AS (SELECT term, path, count(*)::INTEGER AS tf FROM (SELECT path, unnest({_words("body")}) AS term FROM corpus) GROUP BY ALL)"""
SQL["tokenize_tf"] = f"WITH {_POSTINGS} SELECT * FROM postings"
SQL["corpus_stats"] = f"WITH {_CORPUS} SELECT count(*) AS n, round(avg(dl), 6) AS avg_dl FROM docs"
SQL["term_df_top"] = f"WITH {_POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"

QUERY, DOUBLE, SECOND = "garbage collector memory leak", "notaire tribunal tribunal", "memory leak stack trace"
_SCORE = "ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)))"


def _bm25(queries: str, k: int, *, name: str = "bm25", inside: str = "true", scope: str = "true", boost: bool = False) -> str:
    """CTEs that end in ``name``(query_id, path, score, rank); queries: a SELECT of query_id, query."""
    made = "CASE WHEN kind <> 'chunk' THEN 1.2 * CASE WHEN stale THEN 0.5 ELSE 1 END ELSE 1 END" if boost else "1"
    return f"""
{name}_t AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_words("query")}) AS term FROM ({queries})) GROUP BY ALL),
{name}_p AS (SELECT p.* FROM postings p JOIN docs USING (path) WHERE {scope}),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_c AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM docs WHERE {scope}),
{name}_s AS (SELECT query_id, path, round(sum(weight * {_SCORE}) * any_value({made}), 6) AS score FROM {name}_t JOIN {name}_p USING (term) JOIN {name}_d USING (term) JOIN docs USING (path), {name}_c WHERE {inside} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM {name}_s) WHERE rank <= {k})"""


def _one(text: str) -> str:
    return f"SELECT 0 AS query_id, '{text}' AS query"


def _search(text: str, k: int, **kw) -> str:
    return f"WITH {_POSTINGS}, {_bm25(_one(text), k, **kw)} SELECT path, score, rank FROM bm25"


_ENG = "starts_with(path, 'eng/')"
SQL["bm25_topk"] = _search(QUERY, 10)
SQL["bm25_domain_global"] = _search(QUERY, 10, inside=_ENG)
SQL["bm25_domain_local"] = _search(QUERY, 10, inside=_ENG, scope=_ENG)
SQL["bm25_dup_terms"] = _search(DOUBLE, 10)
SQL["bm25_synth_boost_stale"] = _search(QUERY, 50, boost=True)
_QUESTIONS = "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL"
SQL["bm25_batch"] = f"WITH {_POSTINGS}, {_bm25(_QUESTIONS, 10)} SELECT query_id, path, score, rank FROM bm25"
SQL["retrieved_log"] = f"""WITH {_POSTINGS}, {_bm25(_QUESTIONS, 3)}
SELECT 'query_1735689600_' || query_id AS source, path AS target, 'retrieved' AS etype, '1735689600' AS metadata FROM bm25"""

_COUNTS = f"""
cnt AS (SELECT path, dl, w, ((dl - length(replace(lower(body), w, ''))) / length(w))::INTEGER AS m FROM docs, (SELECT unnest(string_split('{QUERY}', ' ')) AS w))"""
_SCAN = f"""{_COUNTS},
sd AS (SELECT w, count(*) FILTER (m > 0) AS df FROM cnt GROUP BY 1),
sc AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM docs),
scan_s AS (SELECT path, round(sum({_SCORE.replace("tf", "m")}), 6) AS score FROM cnt JOIN sd USING (w), sc WHERE m > 0 GROUP BY 1)"""


def _top(source: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM {source} QUALIFY rank <= {k})"


SQL["bm25_scan_substring"] = f"WITH {_CORPUS}, {_SCAN}, {_top('scan_s', 10, 'scan')} SELECT * FROM scan"
_RATE = f"WITH {_CORPUS}, {_COUNTS}, s AS (SELECT path, @ AS score FROM cnt GROUP BY path HAVING sum(m) > 0), {_top('s WHERE score > 0', 10, 'r')} SELECT * FROM r"
SQL["legacy_keyword"] = _RATE.replace("@", "round(sum(m) / any_value(dl), 6)")
SQL["int_keyword"] = _RATE.replace("@", "floor(sum(m) * 10000 / any_value(dl))::DOUBLE")

_VEC = """
v AS (SELECT vec_id, vec_id::VARCHAR AS path, label::VARCHAR AS domain, embedding::DOUBLE[] AS vec FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(vec, vec)) + 1e-10 AS norm FROM v)"""
_KNN = f"""WITH {_VEC},
s AS (SELECT q.vec_id AS query_id, p.path, round(list_dot_product(q.vec, p.vec) / (q.norm * p.norm), 6) AS score FROM u q, u p WHERE q.vec_id % 50 = 0 AND {{}})
SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM s QUALIFY rank <= 10"""
SQL["knn_cosine"] = _KNN.format("true")
SQL["knn_domain"] = _KNN.format("p.domain = '3'")
SQL["knn_candidates"] = _KNN.format("p.domain IN ('1', '2')")
_PAIRS = "p.path < q.path AND list_dot_product(q.vec, p.vec) / (q.norm * p.norm) >= {}"
SQL["relate_exact"] = f"""WITH {_VEC}
SELECT p.domain, p.path AS a, q.path AS b, round(list_dot_product(q.vec, p.vec) / (q.norm * p.norm), 6) AS similarity FROM u p JOIN u q ON p.domain = q.domain AND {_PAIRS.format("0.35")}"""

_LISTS = f"{_POSTINGS}, {_bm25(_one(QUERY), 30)}, {_SCAN}, {_top('scan_s', 30, 'scan')}"


def _rrf(w1: str, w2: str, k: int) -> str:
    return f"""
every AS (SELECT path, rank, 0 AS list, {w1} AS w FROM bm25 UNION ALL SELECT path, rank, 1, {w2} FROM scan),
fused AS (SELECT path, sum(w / (60 + rank)) AS score, min((list * 1000 + rank)) AS seen FROM every GROUP BY 1),
rrf AS (SELECT path, score, row_number() OVER (ORDER BY round(score, 12) DESC, seen, path)::INTEGER AS rank FROM fused QUALIFY rank <= {k})"""


SQL["rrf_fuse"] = f"WITH {_LISTS}, {_rrf('1.0::DOUBLE', '1.0::DOUBLE', 10)} SELECT path, round(score, 6) AS score, rank FROM rrf"
SQL["rrf_weighted"] = f"WITH {_LISTS}, {_rrf('2.0::DOUBLE', '0.5::DOUBLE', 10)} SELECT path, round(score, 6) AS score, rank FROM rrf"
SQL["rerank_blend"] = f"""WITH {_LISTS}, {_rrf('1.0::DOUBLE', '1.0::DOUBLE', 20)},
ce AS (SELECT rrf.path, score, len(list_intersect(list_distinct({_words("'" + QUERY + "'")}), {_words("coalesce(body, '')")}))::DOUBLE / len(list_distinct({_words("'" + QUERY + "'")})) AS c FROM rrf JOIN corpus USING (path)),
n AS (SELECT path, (c - min(c) OVER ()) / CASE WHEN max(c) OVER () > min(c) OVER () THEN max(c) OVER () - min(c) OVER () ELSE 1 END AS r, score / max(score) OVER () AS f FROM ce),
b AS (SELECT path, 0.4::DOUBLE * f + 0.6::DOUBLE * r AS score, r FROM n)
SELECT path, round(score, 6) AS score, round(r, 6) AS reranker, row_number() OVER (ORDER BY round(score, 12) DESC, path)::INTEGER AS rank FROM b"""

_HYBRID = f"""
docs AS (SELECT doc_id::VARCHAR AS path, text AS body, 'chunk' AS kind, false AS stale, length(lower(text)) AS dl FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')),
postings AS (SELECT term, path, count(*)::INTEGER AS tf FROM (SELECT path, unnest({_words("body")}) AS term FROM docs) GROUP BY ALL), {_VEC},
asked AS (SELECT doc_id AS query_id, text AS query, vec, norm FROM documents LEFT JOIN u ON vec_id = doc_id WHERE doc_id % 50 = 0 AND text IS NOT NULL),
{_bm25("SELECT query_id, query FROM asked", 30)},
near AS (SELECT a.query_id, p.path, round(list_dot_product(a.vec, p.vec) / (a.norm * p.norm), 6) AS score FROM asked a, u p
  WHERE a.vec IS NOT NULL AND (EXISTS (SELECT 1 FROM bm25 b WHERE b.query_id = a.query_id AND b.path = p.path) OR NOT EXISTS (SELECT 1 FROM bm25 b WHERE b.query_id = a.query_id))),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM near QUALIFY rank <= 30),
every AS (SELECT query_id, path, rank, 0 AS list FROM bm25 UNION ALL SELECT query_id, path, rank, 1 FROM knn),
fused AS (SELECT query_id, path, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM every GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, path)::INTEGER AS rank FROM fused QUALIFY rank <= 10)"""
SQL["hybrid_search"] = f"WITH {_HYBRID} SELECT query_id, path, round(score, 6) AS score, rank FROM rrf"
SQL["hybrid_explain"] = f"""WITH {_HYBRID} SELECT r.query_id, r.path, r.rank, coalesce(b.score, 0) AS bm25, coalesce(k.score, 0) AS vector, round(r.score, 6) AS rrf
FROM rrf r LEFT JOIN bm25 b USING (query_id, path) LEFT JOIN knn k USING (query_id, path)"""

SQL["chunk_fixed"] = r"""
SELECT doc_id, position, body FROM (SELECT doc_id, (i + 1)::INTEGER AS position, substring(text, i * 900 + 1, 1000) AS body FROM documents,
  unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + ceil((length(text) - 1000) / 900.0)::INT END)) AS r(i) WHERE length(text) > 0)
WHERE regexp_matches(body, '[^\s\p{Z}]')"""
SQL["chunk_sentences"] = r"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS p FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [text] ELSE p END AS p FROM s)
SELECT doc_id, i::INTEGER AS position, p[i] AS body FROM f, unnest(range(1, len(p) + 1)) AS r(i)"""
SQL["parse_html"] = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents"""
SQL["parse_csv_records"] = r"""
SELECT n_nationkey, '--- Record ' || row_number() OVER (ORDER BY n_nationkey) || ' ---' || chr(10) || 'n_nationkey: ' || n_nationkey || CASE WHEN coalesce(n_name, '') <> '' THEN chr(10) || 'n_name: ' || n_name ELSE '' END
  || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation"""
SQL["parse_json_flat"] = r"""
SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) AS plain FROM events"""
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
SQL["detect_type"] = f"""
SELECT DISTINCT path, CASE WHEN {_EXT} = 'md' THEN 'markdown' WHEN {_EXT} IN ('py', 'js', 'ts', 'go', 'rs', 'sh') THEN 'code' WHEN {_EXT} IN ('csv', 'json', 'html') THEN {_EXT} ELSE 'text' END AS ftype FROM sources"""
SQL["strip_markdown"] = r"""
SELECT DISTINCT path, md5(CASE WHEN starts_with(content, '---') AND instr(substring(content, 4), '---') > 0
  THEN regexp_replace(substring(content, instr(substring(content, 4), '---') + 6), '^\n+', '') ELSE content END) AS rest FROM sources"""
SQL["sanitize_names"] = "SELECT p_partkey, coalesce(nullif(regexp_replace(lower(p_name), '[^a-z0-9._-]', '', 'g'), ''), 'document') AS name FROM part"
SQL["frontmatter_split"] = r"""
WITH n AS (SELECT file_id, content, regexp_extract(content, '(?s)^---\n(.*?)\n---\n(.*)$', 1) AS front, regexp_matches(content, '(?s)^---\n(.*?)\n---\n(.*)$') AS has FROM chunk_files WHERE content IS NOT NULL)
SELECT file_id, CASE WHEN regexp_matches(front, '(?m)^type:') THEN trim(regexp_extract(front, '(?m)^type:[ \t]*(.*)$', 1)) END AS type,
  CASE WHEN regexp_matches(front, '(?m)^position:') THEN trim(regexp_extract(front, '(?m)^position:[ \t]*(.*)$', 1)) END AS position,
  md5(CASE WHEN has THEN regexp_extract(content, '(?s)^---\n(.*?)\n---\n(.*)$', 2) ELSE content END) AS body FROM n"""
SQL["domain_rules"] = """
SELECT DISTINCT path, CASE WHEN contains(lower(path), '/eng/') THEN 'engineering' WHEN contains(lower(path), 'legal') OR contains(lower(path), 'finance') THEN 'law'
  WHEN contains(lower(path), '.py') OR contains(lower(path), '.rs') THEN 'code' WHEN contains(lower(path), 'clinic') THEN 'health' ELSE 'unsorted' END AS domain FROM sources"""
SQL["content_hash_dedup"] = "SELECT substring(sha256(text), 1, 16) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"
SQL["stream_ingest_dedup"] = "SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL"
SQL["stream_term_df"] = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_words('text')})) AS term FROM documents) GROUP BY 1"
SQL["stream_event_sessions"] = """
WITH o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, round(sum(value), 6) AS value FROM s GROUP BY user_id, n"""
SQL["ledger_antijoin"] = """
SELECT DISTINCT path, content_hash FROM sources s WHERE NOT EXISTS (SELECT 1 FROM sources r WHERE r.removed_at IS NOT NULL AND r.path = s.path AND r.content_hash = s.content_hash)"""
SQL["vector_reuse"] = r"""
WITH h AS (SELECT doc_id, substring(sha256(text), 1, 16) AS content_hash FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]'))
SELECT doc_id::VARCHAR AS path, content_hash, content_hash IN (SELECT content_hash FROM h WHERE doc_id % 2 = 0) AS reused FROM h"""

SQL["graph_summary"] = f"""WITH {_CORPUS}, {_EDGES}
SELECT count(DISTINCT split_part(path, '/', 1)) AS domains, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS documents, count(DISTINCT path) AS chunks, (SELECT count(*) FROM e) AS edges
FROM corpus WHERE regexp_matches(path, '(^|/)[0-9][^/]*$')"""
SQL["edge_type_hist"] = f"WITH {_EDGES} SELECT etype, count(*) AS n FROM e GROUP BY 1"
_EDGES_META = _EDGES.replace("created_at FROM", "coalesce(metadata, '') AS metadata FROM")
SQL["neighbors"] = f"""WITH {_EDGES_META}
SELECT 'outgoing' AS direction, target AS node, etype, metadata FROM e WHERE source = 'kb/handbook' UNION ALL SELECT 'incoming', source, etype, metadata FROM e WHERE target = 'kb/handbook'"""
SQL["edge_adjacency"] = f"""WITH {_EDGES}, a AS (SELECT source AS node, 'outgoing' AS direction, target AS other FROM e UNION ALL SELECT target, 'incoming', source FROM e)
SELECT node, direction, count(*) AS degree, count(DISTINCT other) AS others FROM a GROUP BY 1, 2"""
_PARENT_TYPE = _WALK.replace("arg_min(target, seq) AS parent", "arg_min(target, seq) AS parent, arg_min(etype, seq) AS etype")
SQL["trace_chain"] = _PARENT_TYPE + """
SELECT f.node AS start, i::INTEGER AS step, up[i + 1] AS node, p.parent, coalesce(p.etype, 'origin') AS etype FROM found f CROSS JOIN unnest(range(0, len(up))) AS r(i) LEFT JOIN p ON p.node = up[i + 1] WHERE up IS NOT NULL"""
SQL["trace_cycle"] = _PARENT_TYPE + """,
c AS (SELECT f.node AS start, w.seen FROM found f JOIN (SELECT node, arg_max(seen, len(seen)) AS seen FROM w GROUP BY node) w USING (node) WHERE up IS NULL)
SELECT c.start, (i - 1)::INTEGER AS step, c.seen[i] AS node, p.parent, p.etype FROM c CROSS JOIN unnest(range(1, len(c.seen) + 1)) AS r(i) JOIN p ON p.node = c.seen[i]"""
_COMPONENTS = f"""
WITH RECURSIVE {_VEC}, pairs AS (SELECT p.path AS a, q.path AS b FROM u p JOIN u q ON {_PAIRS.format("0.4")}),
both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
label AS (SELECT a AS path, least(a, min(b)) AS component FROM reach GROUP BY a),
comp AS (SELECT component, path, count(*) OVER (PARTITION BY component) AS size FROM label QUALIFY size >= 3)"""
SQL["components"] = _COMPONENTS + "SELECT * FROM comp"
SQL["synth_cluster_hash"] = _COMPONENTS + "SELECT component, '_synthesis/_synth_' || substring(sha256(string_agg(path, ',' ORDER BY path)), 1, 8) || '.txt' AS name FROM comp GROUP BY 1"

SQL["graph_expand"] = f"""WITH {_POSTINGS}, {_bm25(_one(QUERY), 10)}, {_EDGES},
hit AS (SELECT target AS path, score * 0.8 AS score, rank * 1000000000 + seq AS o FROM bm25 JOIN e ON e.source = bm25.path WHERE rank <= 5 AND etype IN ('related_to', 'references', 'derived_from')
  AND target NOT IN (SELECT path FROM bm25) AND target IN (SELECT path FROM corpus)),
best AS (SELECT path, arg_min(score, o) AS score, min(o) AS o FROM hit GROUP BY 1)
SELECT path, round(score, 6) AS score, ((SELECT max(rank) FROM bm25) + row_number() OVER (ORDER BY o, path))::INTEGER AS rank FROM best"""
_BUDGET = rf"""WITH {_POSTINGS}, {_bm25(_one(QUERY), 50)},
t AS (SELECT bm25.path, score, rank, body, floor(len(list_filter(regexp_split_to_array(body, '[\s\p{{Z}}\x1c-\x1f\x85]+'), lambda w: w <> '')) * 1.3::DOUBLE)::INTEGER AS tokens FROM bm25 JOIN corpus USING (path)),
b AS (SELECT *, sum(tokens) OVER (ORDER BY rank, path)::BIGINT AS used FROM t QUALIFY used <= 1000)"""
SQL["context_budget"] = _BUDGET + "SELECT rank, path, tokens, used FROM b"
SQL["context_string"] = _BUDGET + "SELECT string_agg('--- Source: ' || path || ' (score: ' || printf('%.4f', score) || ') ---' || chr(10) || body, chr(10) || chr(10) ORDER BY rank) AS context FROM b"
SQL["merge_attempts"] = f"""WITH {_POSTINGS}, {_bm25(_one(QUERY), 10)}, {_bm25(_one(SECOND), 10, name="again")},
every AS (SELECT 1 AS attempt, path, rank FROM bm25 UNION ALL SELECT 2, path, rank FROM again),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY path ORDER BY attempt, rank) = 1)
SELECT attempt, path, row_number() OVER (ORDER BY attempt, rank, path)::INTEGER AS rank FROM once"""
SQL["result_preview"] = rf"""WITH {_CORPUS}
SELECT path, substring(array_to_string(list_slice(string_split(body, chr(10)), 1, 2), ' '), 1, 120) AS preview,
  floor(len(list_filter(regexp_split_to_array(body, '[\s\p{{Z}}\x1c-\x1f\x85]+'), lambda w: w <> '')) * 1.3::DOUBLE)::INTEGER AS tokens FROM corpus WHERE body IS NOT NULL"""

SQL["quality_report"] = rf"""WITH {_CORPUS}, {_EDGES},
c AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS doc, CASE WHEN len(string_split(path, '/')) >= 3 THEN split_part(path, '/', 1) END AS dom, regexp_matches(path, '(^|/)_[^/]*$') AS made,
  regexp_matches(path, '(^|/)[0-9][^/]*$') AS raw, coalesce(has_provenance, false) AS prov, coalesce(stale, false) AS old FROM corpus WHERE NOT starts_with(path, '_') AND contains(path, '/')),
ends AS (SELECT DISTINCT regexp_extract(p, '^[^/]*(/[^/]*)?') AS doc FROM (SELECT source AS p FROM e UNION ALL SELECT target FROM e)),
d AS (SELECT doc, max(made) AS made FROM c GROUP BY 1),
k AS (SELECT (SELECT count(DISTINCT dom) FROM c) AS domains, (SELECT count(*) FROM c WHERE raw) AS chunks, (SELECT count(*) FROM c WHERE made) AS synthesis_nodes, (SELECT count(*) FROM c WHERE made AND old) AS stale_nodes,
  (SELECT count(*) FROM c WHERE raw AND prov) AS chunks_with_provenance, (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d WHERE made) AS documents_with_synthesis,
  (SELECT count(*) FROM d WHERE doc IN (SELECT doc FROM ends)) AS documents_with_edges,
  (SELECT count(*) FROM c WHERE raw AND path IN (SELECT path FROM chunk_vectors WHERE vec IS NOT NULL)) AS chunks_with_embeddings,
  (SELECT count(*) FROM c WHERE raw AND path IN (SELECT path FROM docs)) AS chunks_indexed, (SELECT count(*) FROM e) AS edges),
r AS (SELECT *, chunks_with_provenance / chunks AS provenance_coverage, chunks_with_embeddings / chunks AS embedding_coverage, chunks_indexed / chunks AS bm25_coverage, edges / documents AS edge_density,
  1 - documents_with_edges / documents AS orphan_rate, documents_with_synthesis / documents AS synthesis_coverage, stale_nodes / synthesis_nodes AS stale_rate FROM k)
SELECT * EXCLUDE (provenance_coverage, embedding_coverage, bm25_coverage, edge_density, orphan_rate, synthesis_coverage, stale_rate), round(provenance_coverage, 6) AS provenance_coverage,
  round(embedding_coverage, 6) AS embedding_coverage, round(bm25_coverage, 6) AS bm25_coverage, round(edge_density, 6) AS edge_density, round(orphan_rate, 6) AS orphan_rate,
  round(synthesis_coverage, 6) AS synthesis_coverage, round(stale_rate, 6) AS stale_rate,
  round((provenance_coverage + embedding_coverage + bm25_coverage + (1 - orphan_rate) + synthesis_coverage + (1 - stale_rate)) / 6, 6) AS overall_score FROM r"""
SQL["verify_orphans"] = f"""WITH {_CORPUS}, {_EDGES}
SELECT 'unreadable_chunks' AS finding, count(*) AS n FROM corpus WHERE body IS NULL
UNION ALL SELECT 'orphan_edges', count(*) FROM e WHERE ends_with(source, '.txt') AND source NOT IN (SELECT path FROM corpus)
UNION ALL SELECT 'unusable_vectors', count(*) FROM chunk_vectors WHERE vec IS NULL OR len(vec) <> 96
UNION ALL SELECT 'orphan_vectors', count(*) FROM chunk_vectors v WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.path = v.path)
UNION ALL SELECT 'stale_ledger', count(*) FROM (SELECT DISTINCT path FROM sources) s WHERE path NOT IN (SELECT path FROM sources WHERE removed_at IS NULL)"""
SQL["gc_edges"] = f"WITH {_CORPUS}, {_EDGES} SELECT seq, source, target, etype FROM e WHERE NOT ends_with(source, '.txt') OR source IN (SELECT path FROM corpus)"
SQL["stale_nodes"] = f"""WITH {_CORPUS}, {_EDGES},
again AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS doc FROM corpus WHERE kind = 'chunk' AND starts_with(path, 'eng/')),
far AS (SELECT DISTINCT source AS path FROM e WHERE etype IN ('derived_from', 'synthesizes') AND regexp_replace(target, '/[^/]*$', '') IN (SELECT doc FROM again))
SELECT path, coalesce(stale, false) OR CASE WHEN starts_with(path, '_queries/') OR starts_with(path, '_synthesis/') THEN path IN (SELECT path FROM far)
  ELSE regexp_replace(path, '/[^/]*$', '') IN (SELECT doc FROM again) END AS stale FROM corpus WHERE regexp_matches(path, '(^|/)_[^/]*$')"""
SQL["entity_json_parse"] = "SELECT DISTINCT p_brand, p_name AS name, p_type AS type FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL"
SQL["contradicts_parse"] = "SELECT c_custkey, c_name || ' of ' || c_mktsegment AS body, 'a/' || c_nationkey || '.txt|b/' || c_custkey || '.txt' AS contradicts FROM customer"
SQL["answer_filing"] = r"""
WITH a AS (SELECT text, coalesce(source, '?') AS answer FROM documents WHERE doc_kind = 'query' AND regexp_matches(text, '[^\s\p{Z}]'))
SELECT '_queries/_answer_' || substring(sha256(text), 1, 8) || '.txt' AS path, md5('Q: ' || text || chr(10) || chr(10) || 'A: ' || min(answer)) AS body FROM a GROUP BY text"""
SQL["config_effective"] = """
SELECT trim(key) AS key, nullif(trim(arg_min(coalesce(value, '<none>'), ord)), '<none>') AS value FROM store_config WHERE key IS NOT NULL AND trim(key) <> '' AND NOT starts_with(trim(key), '#') GROUP BY 1"""

# chunks of the sources, by a fold over the lines (or paragraphs) of each
_BLANKS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_STRIP = rf"'^{_BLANKS}+|{_BLANKS}+$', '', 'g'"
_SOME = rf"'[^\s\p{{Z}}\x0b\x1c-\x1f\x85]'"
_SIZE, _OVERLAP = 1000, 100


def _fold(strategy: str, parts: str, joint: str, cuts: str, heading: str, fills: str, only: str = "true") -> str:
    """Each step takes one part x (null behind the last) into what is held: ``cuts`` before it, or after it where ``fills`` says so."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, path, coalesce(content, '') AS content, {parts} AS parts FROM (SELECT DISTINCT path, content FROM sources WHERE {only})),
f AS (SELECT id, 0 AS i, NULL::VARCHAR AS held, 0::BIGINT AS n, '' AS heading, NULL::VARCHAR AS body, '' AS under FROM d
UNION ALL SELECT id, i + 1,
  CASE WHEN x IS NULL THEN NULL WHEN before THEN right(held, {_OVERLAP}) || {joint} || x WHEN after THEN right(more, {_OVERLAP}) ELSE more END,
  CASE WHEN x IS NULL THEN 0 WHEN before THEN length(right(held, {_OVERLAP})) + length(x) WHEN after THEN length(right(more, {_OVERLAP})) ELSE n + length(x) + 1 END,
  {heading}, CASE WHEN x IS NULL OR before THEN held WHEN after THEN more END, heading
FROM (SELECT *, x IS NOT NULL AND NOT before AND {fills} AS after FROM (SELECT f.*, d.parts[i + 1] AS x, CASE WHEN held IS NULL THEN x ELSE held || {joint} || x END AS more, coalesce({cuts}, false) AS before
  FROM f JOIN d USING (id) WHERE i <= len(d.parts)))),
c AS (SELECT id, i, body, under AS heading FROM f WHERE regexp_matches(body, {_SOME}) UNION ALL SELECT id, 0, content, '' FROM d WHERE id NOT IN (SELECT id FROM f WHERE regexp_matches(body, {_SOME}))),
chunks AS (SELECT path, '{strategy}' AS strategy, count(*) OVER (PARTITION BY id)::INTEGER AS total, row_number() OVER (PARTITION BY id ORDER BY i)::INTEGER AS position, body, heading, id, i FROM c JOIN d USING (id))"""


_LINES = "string_split(coalesce(content, ''), chr(10))"
_HEADINGS = ("chr(10)", "starts_with(x, '#') AND n > 0", f"CASE WHEN starts_with(x, '#') THEN regexp_replace(x, {_STRIP}) ELSE heading END", f"NOT starts_with(x, '#') AND n + length(x) + 1 >= {_SIZE}")
_OPENS = rf"regexp_matches(x, '^{_BLANKS}*(def |class |function |const |let |var |export |pub fn |fn |func )') AND n > 0"
_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\n{_BLANKS}*\n'), lambda p: regexp_replace(p, {_STRIP})), lambda p: p <> '')"
_CHUNKS = " SELECT path, strategy, total, position, body, heading FROM chunks"
SQL["chunk_heading"] = _fold("heading", _LINES, *_HEADINGS) + _CHUNKS
SQL["chunk_function"] = _fold("function", _LINES, "chr(10)", _OPENS, "heading", f"n + length(x) + 1 >= {_SIZE}") + _CHUNKS
SQL["chunk_paragraph"] = _fold("paragraph", _PARAGRAPHS, "chr(10) || chr(10)", f"length(held) + length(x) + 2 > {_SIZE}", "heading", "false") + _CHUNKS
_EXT = r"regexp_extract(lower(path), '\.([^./]+)$', 1)"
_CODE = f"{_EXT} IN ('py', 'js', 'ts', 'go', 'rs', 'sh')"
SQL["chunk_selected"] = " UNION ALL ".join(
    f"SELECT * FROM ({q + _CHUNKS})"
    for q in (
        _fold("heading", _LINES, *_HEADINGS, f"NOT {_CODE} AND {_EXT} <> 'txt'"),
        _fold("function", _LINES, "chr(10)", _OPENS, "heading", f"n + length(x) + 1 >= {_SIZE}", _CODE),
        _fold("paragraph", _PARAGRAPHS, "chr(10) || chr(10)", f"length(held) + length(x) + 2 > {_SIZE}", "heading", "false", f"{_EXT} = 'txt'"),
    )
)
SQL["chunk_proposition"] = (
    _fold("proposition", _LINES, *_HEADINGS)
    + rf""",
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, {_STRIP}), '([.!?]){_BLANKS}+', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, {_STRIP})), lambda p: length(p) > 10) AS parts FROM chunks),
u AS (SELECT path, strategy, heading, id, i, unnest(range(greatest(len(parts), 1))) AS k, parts, body FROM s)
SELECT path, strategy, count(*) OVER (PARTITION BY id)::INTEGER AS total, row_number() OVER (PARTITION BY id ORDER BY i, k)::INTEGER AS position, coalesce(parts[k + 1], body) AS body, heading FROM u"""
)

# the chunk a file was written for, and its body as it reads on a screen
_FILES = r"""
WITH n AS (SELECT file_id, content, regexp_replace(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/+', '/', 'g'), '^(?:\./|/|(?:_staging|_?lost\+found|retry-\d+|\.trash|tmp)/)+', ''),
  '^((?:.*/)?)\.?([^/]*?)(?:-\d+~| ?\((?:copy|\d+)\)| copy)?\.txt(?:~|\.(?:bak|tmp|swp|orig|old|part))*$', '\1\2.txt') AS chunk FROM chunk_files),
b AS (SELECT file_id, chunk, regexp_replace(regexp_replace(content, '(?s)^\x{FEFF}?---[ \t]*\r?\ntype:.*?\n---[ \t]*(?:\r?\n|$)', ''), '^\x{FEFF}', '') AS body FROM n),
s AS (SELECT file_id, chunk, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(body), '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '[\x{00A0}\x{2007}\x{202F}]', ' ', 'g'),
  '[ \t\r\f\v]+\n', chr(10), 'g'), '\r', chr(10), 'g'), '^[ \t\n]*\n|\s+$', '', 'g') AS shown FROM b)"""
SQL["p4_found"] = _FILES + " SELECT file_id FROM (SELECT file_id, min(file_id) OVER (PARTITION BY chunk, shown) AS first FROM s WHERE shown <> '') WHERE file_id > first"
SQL["p4_records"] = _FILES + """
SELECT r.file_id, r.chunk AS path, md5(f.content) AS content FROM (SELECT chunk, shown, min(file_id) AS file_id FROM s WHERE shown <> '' GROUP BY 1, 2) r JOIN chunk_files f USING (file_id)"""
SQL["p4_manifest"] = _FILES + """
SELECT count(*) AS records, sum(octet_length(encode(f.content)))::BIGINT AS content_bytes, 0::BIGINT AS oversized
FROM (SELECT chunk, shown, min(file_id) AS file_id FROM s WHERE shown <> '' GROUP BY 1, 2) r JOIN chunk_files f USING (file_id)"""
SQL["relate_recall"] = f"SELECT count(*) AS wanted, true AS reached FROM ({SQL['relate_exact']})"
SQL["related_edges"] = f"""
WITH {_EDGES}, cfg AS (SELECT trim(key) AS k, trim(arg_min(value, ord)) AS v FROM store_config WHERE key IS NOT NULL AND NOT starts_with(trim(key), '#') GROUP BY 1),
v AS (SELECT path, coalesce(domain, '') AS domain, vec::DOUBLE[] AS vec FROM chunk_vectors WHERE len(vec) = (SELECT v::INT FROM cfg WHERE k = 'embedding.dimensions') AND len(list_filter(vec, lambda x: isnan(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY embedded_at DESC NULLS LAST, vec_id DESC) = 1),
u AS (SELECT path, domain, vec, sqrt(list_dot_product(vec, vec)) + 1e-10 AS norm FROM v),
p AS (SELECT a.path AS source, b.path AS target, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS s FROM u a JOIN u b ON a.domain = b.domain AND a.path < b.path)
SELECT source, target, 'related_to' AS etype, printf('similarity=%.4f', s) AS metadata FROM p WHERE s >= (SELECT v::DOUBLE FROM cfg WHERE k = 'edges.relate_threshold')
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.etype = 'related_to' AND least(e.source, e.target) = p.source AND greatest(e.source, e.target) = p.target)"""
