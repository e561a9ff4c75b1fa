"""Keyword, vector and hybrid search over chunks, for one or many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..scratch import Table
from . import bm25, fuse, vector

#: What a model is asked for in place of a query.
HYDE = "You write a short passage that would answer the question, as it might stand in a document."
MODES = ("keyword", "vector", "hybrid")


def live_chunks(chunks: DataFrame) -> DataFrame:
    """(path, domain, doc_path, body, kind, stale, ...) of the latest version of each path that is not deleted.

    Versions are ordered by ``written_at``, then content; repeated rows count once.
    """
    w = Window.partitionBy("path").orderBy(F.desc("written_at"), F.desc("content"), F.desc("deleted_at"), F.desc("domain"), F.desc("stale"))
    now = chunks.where(F.col("path").isNotNull()).withColumn("_v", F.row_number().over(w)).where((F.col("_v") == 1) & F.col("deleted_at").isNull())
    return now.drop("_v").withColumnRenamed("content", "body").withColumn("domain", F.coalesce("domain", X.domain_of("path")))


def hydrate(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with ``content`` and ``domain`` of their paths; '' where the chunk is gone."""
    of = chunks.select("path", F.col("body").alias("content"), "domain")
    joined = results.join(of, "path", "left")
    return joined.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("domain", F.coalesce("domain", X.domain_of("path")))


def hyde(queries: DataFrame, cache: DataFrame, write: Callable[[str], str] | None) -> tuple[DataFrame, DataFrame]:
    """(queries with ``expanded``, new cache rows): a hypothetical answer in place of the query for the vector arm.

    ``cache``: (query_hash, passage). ``write`` is called for queries without one; without it, or
    where it gives nothing, the query itself is used and nothing is cached.
    """
    q = queries.withColumn("query_hash", X.content_hash("query"))
    known = cache.groupBy("query_hash").agg(F.first("passage").alias("passage"))
    if write is None:
        return q.join(known, "query_hash", "left").withColumn("expanded", F.coalesce("passage", "query")).drop("passage", "query_hash"), cache.limit(0)
    ask = F.udf(lambda text: write(text) or None, "string")
    new = q.join(known, "query_hash", "left_anti").groupBy("query_hash").agg(F.first("query").alias("query")).select("query_hash", ask("query").alias("passage")).where(F.col("passage").isNotNull())
    both = known.unionByName(new)
    return q.join(both, "query_hash", "left").withColumn("expanded", F.coalesce("passage", "query")).drop("passage", "query_hash"), new


def search(
    chunks: DataFrame | None, vectors: DataFrame | None, queries: DataFrame, mode: str = "hybrid", *, top: int = 10, domain: str = "",
    boost: float = 1.2, stale_penalty: float = 0.5, scorer=None, keyword_only_candidates: bool = True, weights: tuple[float, float] = (1.0, 1.0),
    index: DataFrame | None = None, stats: DataFrame | None = None, many: bool = False,
) -> DataFrame:
    """(query_id, path, score, rank, explain): the best ``top`` chunks for each query.

    ``chunks``: (path, domain, body, kind, stale); ``vectors``: (path, domain, vec); ``queries``:
    (query_id, query, vec), vec only for the vector arm. Hybrid takes 3 x top keyword hits, the 3 x
    top nearest vectors among these (among all for queries without a hit, or if
    ``keyword_only_candidates`` is false), fuses both by rank, and reranks if there is a scorer.
    Without vectors every mode but keyword falls back to keyword. ``index`` and ``stats``: stored
    postings and document stats, with which the chunks are read by a scorer only. ``many``: for many
    or long queries. The lists of both arms are made once and kept in tables.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    by = ["query_id"]

    def keyword(k: int) -> DataFrame:
        find = bm25.search_many if many else bm25.search
        return find(chunks, queries.select("query_id", "query"), k, domain=domain, boost=boost, stale_penalty=stale_penalty, index=index, stats=stats)

    if mode == "keyword" or vectors is None:
        hits = keyword(top)
        return fuse.explain(hits, {"bm25": hits}, by)
    asked = queries.select("query_id", "vec").where(F.col("vec").isNotNull())
    near = vectors.where(F.col("domain") == domain) if domain else vectors
    if mode == "vector":
        hits = vector.knn(near, asked, top)
        return fuse.explain(hits, {"vector": hits}, by)
    words = Table(keyword(3 * top), "words").df
    if keyword_only_candidates:
        among = vector.knn(near, asked, 3 * top, candidates=words.select("query_id", "path"))
        lost = Table(asked.join(words.select("query_id").distinct(), "query_id", "left_anti"), "lost").df
        meaning = among if lost.isEmpty() else among.unionByName(vector.knn(near, lost, 3 * top))
    else:
        meaning = vector.knn(near, asked, 3 * top)
    meaning = Table(meaning, "meaning").df
    fused = fuse.rrf([words, meaning], weights=weights, top=top, by=by)
    parts = {"bm25": words, "vector": meaning, "rrf": fused}
    if scorer is not None:
        texts = hydrate(fused, chunks).join(queries.select("query_id", "query"), "query_id")
        again = fuse.rerank(texts, scorer, top=top, by=by)
        parts["reranker"] = again.select("query_id", "path", F.col("reranker").alias("score"))
        fused = again.drop("reranker")
    return fuse.explain(fused, parts, by)
