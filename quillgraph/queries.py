"""Queries of the core: name to function of (session, table folder)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text as X
from .operators import bm25, chunk, compaction, context, edges, fuse, graph, hierarchy, orphans, quality, search, synthesis, vector
from .scratch import Table, new_path
from .sources import files, parse
from .streaming import ingest

#: What the search queries ask for, and the domain and node that some are limited to.
QUERY, DOUBLE, DOMAIN, NODE = "garbage collector memory leak", "notaire tribunal tribunal", "eng", "kb/handbook"
#: Similarity from which vectors of ``embeddings`` are related (their greatest cosines are about 0.5).
THRESHOLD = 0.35
RULES = [(0, "/eng/", "engineering"), (1, "legal", "law"), (1, "finance", "law"), (2, ".py", "code"), (2, ".rs", "code"), (3, "clinic", "health")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.edge_orphans(*(table(spark, d, t) for t in ("edges", "chunks", "sources", "collections")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("seq", "side", "reason").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Ends that do not resolve by type, side, month and reason."""
    return orphans.orphan_report(_orphans(spark, d))


def p1_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys with partial nulls, under all four semantics: lines refer to part and supplier, of which some are unknown, and the pairs sold in quantity are the records."""
    lines = table(spark, d, "lineitem")
    part = F.when(F.col("l_linenumber") % 3 != 1, F.col("l_partkey")).alias("part")
    supplier = F.when(F.col("l_linenumber") % 4 != 2, F.col("l_suppkey")).alias("supplier")
    refs = lines.select("l_orderkey", "l_linenumber", "l_shipdate", part, supplier)
    sold = lines.where(F.col("l_quantity") > 25).select(
        F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")).alias("supplier"), F.col("l_shipdate").alias("born"), F.when(F.col("l_tax") > 0.05, F.col("l_shipdate")).alias("died")
    )
    found = [orphans.find_orphans(refs, sold, ["part", "supplier"], match=m, at="l_shipdate", born="born", died="died").withColumn("match", F.lit(m)) for m in orphans.MATCHES]
    return reduce(DataFrame.unionByName, found).select("match", "l_orderkey", "l_linenumber", "part", "supplier", "reason")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.provenance_parents(table(spark, d, "edges")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where(F.col("parent").isNotNull()).select("node", "root", "depth")


def p2_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their nested-set ranges: the descendants of a node are those with pre in (pre, pre + size)."""
    return _tree(spark, d)


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every node that has a root."""
    return hierarchy.sweep(_tree(spark, d))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its ancestors, that is every ancestor with all its descendants."""
    return hierarchy.sweep(_tree(spark, d), pairs=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact(table(spark, d, "chunk_files")).repeats


def p4_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the files of the consolidated store hold: records, bytes, and files beyond 128 MB."""
    m = compaction.compact(table(spark, d, "chunk_files")).manifest
    return m.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("content_bytes"), F.lit(0)).alias("content_bytes"), F.count_if(F.col("content_bytes") > 128 << 20).alias("oversized"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that the published files hold, read through the manifest."""
    c = compaction.compact(table(spark, d, "chunk_files"))
    return compaction.read_compacted(spark, c.path).select("file_id", "path", F.md5("content").alias("content"))


# the store's chunks, vectors and edges as the operators take them


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return search.live_chunks(table(spark, d, "chunks"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.valid_edges(table(spark, d, "edges"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("label").cast("string").alias("domain"), F.col("embedding").alias("vec"), "vec_id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The vector queries: every vector whose id is divisible by 50."""
    return _vectors(spark, d).where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vec")


def _one(spark: SparkSession, text: str = QUERY) -> DataFrame:
    return bm25.one_query(spark, text)


def tokenize_tf(spark, d):
    return bm25.postings(corpus(spark, d))


def corpus_stats(spark, d):
    return bm25.corpus_stats(bm25.document_stats(corpus(spark, d))).select("n", F.round("avg_dl", 6).alias("avg_dl"))


def term_df_top(spark, d):
    return bm25.document_frequency(bm25.postings(corpus(spark, d))).orderBy(F.desc("df"), "term").limit(50)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("path", "score", "rank")


def bm25_topk(spark, d):
    return _hits(bm25.search(corpus(spark, d), _one(spark), 10))


def bm25_domain_global(spark, d):
    return _hits(bm25.search(corpus(spark, d), _one(spark), 10, domain=DOMAIN))


def bm25_domain_local(spark, d):
    return _hits(bm25.search(corpus(spark, d), _one(spark), 10, domain=DOMAIN, stats_scope="domain"))


def bm25_dup_terms(spark, d):
    return _hits(bm25.search(corpus(spark, d), _one(spark, DOUBLE), 10))


def bm25_synth_boost_stale(spark, d):
    return _hits(bm25.search(corpus(spark, d), _one(spark), 50, boost=1.2, stale_penalty=0.5))


def bm25_scan_substring(spark, d):
    return bm25.search_scan(corpus(spark, d), QUERY, 10)


def legacy_keyword(spark, d):
    return bm25.keyword_density(corpus(spark, d), QUERY, 10)


def int_keyword(spark, d):
    return bm25.keyword_integer(corpus(spark, d), QUERY, 10)


def _questions(spark, d):
    """The text queries: every document whose id is divisible by 50, with its whole text."""
    return table(spark, d, "documents").where((F.col("doc_id") % 50 == 0) & F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def bm25_batch(spark, d):
    return bm25.search_many(corpus(spark, d), _questions(spark, d), 10)


def knn_cosine(spark, d):
    return vector.knn(_vectors(spark, d), _asked(spark, d), 10)


def knn_domain(spark, d):
    return vector.knn(_vectors(spark, d), _asked(spark, d), 10, domain="3")


def knn_candidates(spark, d):
    return vector.knn(_vectors(spark, d), _asked(spark, d), 10, candidates=_vectors(spark, d).where(F.col("domain").isin("1", "2")).select("path"))


def relate_exact(spark, d):
    return vector.relate_exact(_vectors(spark, d), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


def relate_lsh(spark, d):
    return vector.relate_lsh(_vectors(spark, d), THRESHOLD, dims=64, bits=6).withColumn("similarity", F.round("similarity", 6))


def relate_recall(spark, d):
    """Whether the hyperplane buckets find at least 95% of the related pairs."""
    v = Table(_vectors(spark, d), "vectors").df
    all_ = Table(vector.relate_exact(v, THRESHOLD), "related").df
    got = vector.relate_lsh(v, THRESHOLD, dims=64, bits=6).select("a", "b")
    hits = all_.join(got, ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return all_.agg(F.count(F.lit(1)).alias("wanted")).join(F.broadcast(hits)).select("wanted", (F.col("hits") >= 0.95 * F.col("wanted")).alias("reached"))  # one row each


def related_edges(spark, d):
    """New related_to edges of the stored chunk vectors of the set length, by domain; of several vectors of a path the last counts."""
    c = config.read(spark, d)
    dims = int(c["embedding.dimensions"])
    v = table(spark, d, "chunk_vectors").where((F.size("vec") == dims) & ~F.isnan(F.array_max("vec")))
    v = v.groupBy("path").agg(F.max_by(F.struct("domain", "vec"), F.struct("embedded_at", "vec_id")).alias("v")).select("path", F.coalesce("v.domain", F.lit("")).alias("domain"), "v.vec")
    return vector.relate(v, _edges(spark, d), float(c["edges.relate_threshold"]), dims=dims)


def _lists(spark, d):
    """Two ranked lists of the query: by whole tokens and by substrings."""
    c = Table(corpus(spark, d).select("path", "domain", "body", "kind", "stale"), "corpus").df
    return c, bm25.search(c, _one(spark), 30), bm25.search_scan(c, QUERY, 30)


def rrf_fuse(spark, d):
    _, a, b = _lists(spark, d)
    return fuse.rrf([a, b], top=10).withColumn("score", F.round("score", 6))


def rrf_weighted(spark, d):
    _, a, b = _lists(spark, d)
    return fuse.rrf([a, b], weights=[2.0, 0.5], top=10).withColumn("score", F.round("score", 6))


def rerank_blend(spark, d):
    c, a, b = _lists(spark, d)
    top = search.hydrate(fuse.rrf([a, b], top=20), c).withColumn("query", F.lit(QUERY))
    return fuse.rerank(top, fuse.overlap_scorer).select("path", F.round("score", 6).alias("score"), F.round("reranker", 6).alias("reranker"), "rank")


def _hybrid(spark, d):
    """Hybrid search of documents (path: the id) with the vectors that ``embeddings`` has for them."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    chunks = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit("").alias("domain"), F.col("text").alias("body"), F.lit("chunk").alias("kind"), F.lit(False).alias("stale"))
    v = _vectors(spark, d)
    asked = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")).join(v.select(F.col("vec_id").alias("query_id"), "vec"), "query_id", "left")
    return search.search(chunks, v.select("path", "domain", "vec"), asked, "hybrid", top=10, many=True)


def hybrid_search(spark, d):
    return _hybrid(spark, d).select("query_id", "path", F.round("score", 6).alias("score"), "rank")


def hybrid_explain(spark, d):
    e = F.col("explain")
    return _hybrid(spark, d).select("query_id", "path", "rank", e["bm25"].alias("bm25"), e["vector"].alias("vector"), e["rrf"].alias("rrf"))


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def chunk_fixed(spark, d):
    return chunk.windows(_texts(spark, d))


def chunk_sentences(spark, d):
    return chunk.sentences(_texts(spark, d))


def _chunked(spark, d, strategy):
    s = table(spark, d, "sources").select("path", "content").distinct().withColumn("strategy", F.lit(strategy))
    return chunk.chunk_documents(s, text="content")


def chunk_heading(spark, d):
    return _chunked(spark, d, "heading")


def chunk_paragraph(spark, d):
    return _chunked(spark, d, "paragraph")


def chunk_function(spark, d):
    return _chunked(spark, d, "function")


def chunk_proposition(spark, d):
    return _chunked(spark, d, "proposition")


def chunk_selected(spark, d):
    """Every source chunked by the strategy that its type selects."""
    s = table(spark, d, "sources").select("path", "content").distinct()
    return chunk.chunk_documents(s.withColumn("strategy", chunk.strategy_for(parse.detect_type("path"))), text="content")


def parse_html(spark, d):
    return table(spark, d, "documents").select("doc_id", parse.html_text("text").alias("plain"))


def parse_csv_records(spark, d):
    from pyspark.sql.window import Window

    n = table(spark, d, "nation").withColumn("record", F.row_number().over(Window.orderBy("n_nationkey")))  # 25 rows
    return parse.csv_records(n, F.col("record"), ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "text")


def parse_json_flat(spark, d):
    return table(spark, d, "events").select("event_id", parse.json_text("props").alias("plain"))


def detect_type(spark, d):
    return table(spark, d, "sources").select("path", parse.detect_type("path").alias("ftype")).distinct()


def strip_markdown(spark, d):
    return table(spark, d, "sources").select("path", F.md5(parse.strip_front_matter("content")).alias("rest")).distinct()


def sanitize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.sanitize("p_name").alias("name"))


def frontmatter_split(spark, d):
    n = table(spark, d, "chunk_files").where(F.col("content").isNotNull())
    return n.select("file_id", parse.node_value("content", "type").alias("type"), parse.node_value("content", "position").alias("position"), F.md5(parse.node_body("content")).alias("body"))


def domain_rules(spark, d):
    rules = spark.createDataFrame(RULES, "ord int, pattern string, domain string")
    return files.apply_rules(table(spark, d, "sources").select("path").distinct(), rules)


def content_hash_dedup(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.groupBy(X.content_hash("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def _ledger(spark, d):
    """The ledger of a store that has taken in the sources that are gone by now."""
    return table(spark, d, "sources").where(F.col("removed_at").isNotNull()).select(F.col("path").alias("source_path"), "content_hash").distinct()


def ledger_antijoin(spark, d):
    return files.unprocessed(table(spark, d, "sources").select("path", "content_hash").distinct(), _ledger(spark, d))


class _Constant(vector.Embedder):
    """An engine that tells by its vectors when they were made."""

    def __init__(self, value: float):
        self.dims, self.name, self.value = 1, "constant", value

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[self.value]] * len(texts)


def vector_reuse(spark, d):
    """Documents embedded beside the stored vectors of those with an even id: which take over a stored vector."""
    docs = table(spark, d, "documents").where(X.has_body("text")).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("").alias("domain"), F.col("text").alias("body"))
    stored = Table(vector.embed(docs.where(F.col("doc_id") % 2 == 0), _Constant(1.0)), "stored").df
    made = vector.embed(docs, _Constant(0.0), known=stored)
    return made.select("path", "content_hash", (F.col("vec")[0] == 1).alias("reused"))


def graph_summary(spark, d):
    return graph.summary(corpus(spark, d), _edges(spark, d))


def edge_type_hist(spark, d):
    return graph.edge_types(_edges(spark, d))


def neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), NODE)


def edge_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)).groupBy("node", "direction").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("others"))


def trace_chain(spark, d):
    return graph.trace_all(_edges(spark, d))


def trace_cycle(spark, d):
    """The chains of all nodes that lead into a cycle; they end without an origin."""
    e = Table(_edges(spark, d).where(F.col("etype").isin(*edges.PROVENANCE)), "edges").df
    tree = hierarchy.hierarchy(graph.first_parents(e).select("node", "parent"))
    return graph.trace(e, tree.where("cyclic").select("node"))


def _components(spark, d):
    return graph.components(vector.relate_exact(_vectors(spark, d).withColumn("domain", F.lit("")), 0.4).select("a", "b"))


def components(spark, d):
    return _components(spark, d)


def synth_cluster_hash(spark, d):
    return graph.cluster_names(_components(spark, d))


def _first(spark, d, k=10):
    c = Table(corpus(spark, d).select("path", "domain", "body", "kind", "stale"), "corpus").df
    return c, Table(_hits(bm25.search(c, _one(spark), k)), "hits").df


def graph_expand(spark, d):
    c, hits = _first(spark, d)
    return graph.expand(hits, _edges(spark, d), c).withColumn("score", F.round("score", 6))


def context_budget(spark, d):
    c, hits = _first(spark, d, 50)
    return context.within_budget(search.hydrate(hits, c), 1000).select("rank", "path", "tokens", "used")


def context_string(spark, d):
    c, hits = _first(spark, d, 50)
    return context.assemble(search.hydrate(hits, c), 1000).select("context")


def merge_attempts(spark, d):
    c, hits = _first(spark, d)
    second = _hits(bm25.search(c, _one(spark, "memory leak stack trace"), 10))
    both = hits.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    return context.merge_attempts(both).select("attempt", "path", "rank")


def result_preview(spark, d):
    return corpus(spark, d).where(F.col("body").isNotNull()).select("path", X.preview("body").alias("preview"), X.token_estimate("body").alias("tokens"))


def quality_report(spark, d):
    c = Table(corpus(spark, d), "corpus").df
    embedded = table(spark, d, "chunk_vectors").where(F.col("vec").isNotNull()).select("path")
    r = quality.ratios(quality.counters(c, _edges(spark, d), embedded, bm25.document_stats(c)))
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


def verify_orphans(spark, d):
    c = Table(corpus(spark, d).select("path", "body"), "corpus").df
    sources = table(spark, d, "sources").where(F.col("removed_at").isNull()).select("path").distinct()
    ledger = table(spark, d, "sources").select(F.col("path").alias("source_path")).distinct()
    return quality.verify(c, _edges(spark, d), table(spark, d, "chunk_vectors"), sources, ledger, int(config.read(spark, d)["embedding.dimensions"]))


def gc_edges(spark, d):
    return quality.collect_garbage(_edges(spark, d), corpus(spark, d)).select("seq", "source", "target", "etype")


def stale_nodes(spark, d):
    """Synthesis nodes that are stale once all sources of the domain eng come in again."""
    c = Table(corpus(spark, d), "corpus").df
    e = _edges(spark, d).where(F.col("etype").isin("derived_from", "synthesizes"))
    of = e.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("sources"))
    nodes = c.where(X.is_synthesis("path")).join(of, "path", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    docs = c.where((F.col("kind") == "chunk") & F.col("path").startswith("eng/")).select(F.regexp_replace("path", "/[^/]*$", "").alias("doc_path"))
    return synthesis.mark_stale(nodes.select("path", "sources", "stale"), docs).select("path", "stale")


def entity_json_parse(spark, d):
    """Entities read back from a model's answers made of the part table: one JSON list a brand, in code fences."""
    p = table(spark, d, "part")
    said = p.groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_set(F.struct(F.col("p_type").alias("type"), F.col("p_name").alias("name"))))).alias("j"))
    raw = F.concat(F.lit("```json\n"), "j", F.lit("\n```"))
    return said.select("p_brand", F.explode(synthesis.parse_entities(raw)).alias("e")).select("p_brand", F.col("e.name").alias("name"), F.col("e.type").alias("type"))


def contradicts_parse(spark, d):
    """Cluster syntheses made of the customer table, with a last line that names two contradicted members."""
    raw = F.concat(F.col("c_name"), F.lit(" of "), F.col("c_mktsegment"), F.lit("\nCONTRADICTS: a/"), F.col("c_nationkey").cast("string"), F.lit(".txt, b/"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    s = synthesis.parse_synthesis(raw)
    return table(spark, d, "customer").select("c_custkey", s["body"].alias("body"), F.array_join(s["contradicts"], "|").alias("contradicts"))


def answer_filing(spark, d):
    """Every query document filed as an answered question."""
    q = table(spark, d, "documents").where((F.col("doc_kind") == "query") & X.has_body("text"))
    a = q.select(F.col("text").alias("question"), F.coalesce("source", F.lit("?")).alias("answer"), F.array(F.lit("kb/handbook")).alias("sources"))
    return synthesis.file_answers(a).select("path", F.md5("body").alias("body"))


def retrieved_log(spark, d):
    hits = bm25.search_many(corpus(spark, d), _questions(spark, d), 3)
    return synthesis.retrieved_edges(hits, F.lit("2025-01-01 00:00:00"))


def config_effective(spark, d):
    return config.effective(table(spark, d, "store_config"))


def _streamed(spark: SparkSession, d: str, name: str, plan, mode: str) -> DataFrame:
    """Run a table as a stream through a plan and read what came out."""
    source = table(spark, d, name)
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/{name}.parquet*" if not d.endswith("/") else f"{d}{name}.parquet*")
    out = new_path(spark, "stream")
    made = plan(stream)
    if mode == "append":
        q = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    else:

        def keep(rows: DataFrame, n: int) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/rows")

        q = made.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def stream_ingest_dedup(spark, d):
    return _streamed(spark, d, "documents", lambda s: ingest.distinct_texts(s).select("text_hash"), "append")


def stream_term_df(spark, d):
    return _streamed(spark, d, "documents", ingest.running_terms, "complete")


def stream_event_sessions(spark, d):
    return _streamed(spark, d, "events", ingest.sessions, "complete").withColumn("value", F.round("value", 6))


_NOT = {"table", "corpus", "reduce"}
QUERIES = {
    n: f
    for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _NOT
}
