"""Keyword search: an inverted index as tables, and scores as joins and sums.

Everything works on many queries at once: query terms are rows (query_id, term, weight), a search is
one join of the terms with the postings. The corpus statistics are one row, its size and mean length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..scratch import Table
from . import skew

#: Saturation and length norm of BM25 (fixed values).
K1, B = 1.2, 0.75


def postings(chunks: DataFrame) -> DataFrame:
    """(term, path, tf) of chunks (path, body)."""
    words = chunks.select("path", F.explode(X.tokens("body")).alias("term"))
    return words.groupBy("term", "path").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """(path, dl) and, where there are, kind and stale: dl is the length in characters, of bodies that are not blank."""
    extra = [c for c in ("kind", "stale") if c in chunks.columns]
    return chunks.where(X.has_body("body")).select("path", F.char_length(F.lower("body")).alias("dl"), *extra)


def corpus_stats(stats: DataFrame) -> DataFrame:
    """(n, avg_dl), one row."""
    return stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df)."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, query); a repeated word weighs as often as it comes."""
    words = queries.select("query_id", F.explode(X.tokens("query")).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def one_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id int, query string")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, dl: Column, avg_dl: Column) -> Column:
    norm = F.lit(K1) * (1 - B + B * F.try_divide(dl, avg_dl))
    return tf * (K1 + 1) / (tf + norm)


def boosted(score: Column, boost: float, stale_penalty: float) -> Column:
    """Synthesis nodes weigh more, stale ones less."""
    made = F.col("kind") != "chunk"
    return score * F.when(made, F.lit(boost) * F.when(F.col("stale"), stale_penalty).otherwise(1.0)).otherwise(1.0)


def top(scored: DataFrame, k: int | None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best k rows of each query by score, then path, with their rank; scores are rounded to 6 digits first."""
    scored = scored.withColumn("score", F.round("score", 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "path")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def search(
    chunks: DataFrame | None, queries: DataFrame, k: int | None = 50, *, domain: str = "", stats_scope: str = "global",
    boost: float = 1.0, stale_penalty: float = 1.0, index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """(query_id, path, score, rank): BM25 over chunks (path, body[, kind, stale]) for queries (query_id, query).

    ``domain`` keeps paths below it; with ``stats_scope`` 'domain' it also limits the statistics.
    ``index`` and ``stats``: stored postings and document stats, with which the chunks are not read.
    Blank bodies are no documents; blank queries and terms that no chunk has give no rows. For a few
    short queries; for many or long ones take ``search_many``.
    """
    terms = query_terms(queries)
    hits, df, stats_in, whole = _hits(chunks, terms, domain, stats_scope, index, stats)
    rows = terms.join(hits, "term").join(df, "term").join(stats_in, "path").join(F.broadcast(whole))
    part = F.col("weight") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    extra = [c for c in ("kind", "stale") if c in stats_in.columns]
    scored = rows.groupBy("query_id", "path", *extra).agg(F.sum(part).alias("score"))
    if extra and (boost != 1 or stale_penalty != 1):
        scored = scored.withColumn("score", boosted(F.col("score"), boost, stale_penalty))
    return top(scored.select("query_id", "path", "score"), k)


def _hits(chunks: DataFrame | None, terms: DataFrame, domain: str, stats_scope: str, index: DataFrame | None, stats: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings of the query terms, their document frequencies, stats of the documents searched, corpus stats)."""
    if stats_scope not in ("global", "domain"):
        raise ValueError("stats_scope is 'global' or 'domain'")
    if chunks is None and (index is None or stats is None):
        raise ValueError("chunks, or both index and stats")
    inside = F.col("path").startswith(f"{domain}/") if domain else F.lit(True)
    index = postings(chunks) if index is None else index
    stats = document_stats(chunks) if stats is None else stats
    if stats_scope == "domain":
        index, stats = index.where(inside), stats.where(inside)
    hits = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = document_frequency(hits)
    return hits.where(inside), df, stats.where(inside), corpus_stats(stats)


#: Documents and queries of a block of ``search_many``.
DOCUMENTS, QUERIES = 16_384, 2_048


def search_many(
    chunks: DataFrame | None, queries: DataFrame, k: int = 10, *, domain: str = "", stats_scope: str = "global",
    boost: float = 1.0, stale_penalty: float = 1.0, index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """``search`` for many or long queries, a stated set that is compared with all documents in blocks.

    A word that all texts have would make a row for every query and document, so they are not joined:
    each block of documents meets each block of queries in a task, which adds up the impacts of the
    terms (idf x saturation, by hot-key joins) in an array and passes on only the k best documents of
    a query, and those that tie with the last after rounding.
    """
    terms = Table(query_terms(queries), "terms").df
    hits, df, stats_in, whole = _hits(chunks, terms, domain, stats_scope, index, stats)
    hits = Table(hits, "hits").df
    df = Table(document_frequency(hits) if not domain or stats_scope == "domain" else df, "df").df
    n = hits.count()
    hot = skew.hot_keys(df.select(F.xxhash64("term").alias("h"), F.col("df").alias("n")), n)
    impact = idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    extra = [c for c in ("kind", "stale") if c in stats_in.columns]
    if extra and (boost != 1 or stale_penalty != 1):
        impact = boosted(impact, boost, stale_penalty)
    rows = skew.spread_join(hits, df, ["term"], hot, row=["path"]).join(stats_in, "path").join(F.broadcast(whole)).select("term", "path", impact.alias("w"))
    d_blocks = max(1, -(-stats_in.count() // DOCUMENTS))
    q_blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERIES))
    id_type = queries.schema["query_id"].dataType.simpleString()
    block = lambda c, n: F.pmod(F.xxhash64(F.lit(3), c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    docs = rows.select(block("path", d_blocks).alias("db"), every(q_blocks).alias("qb"), F.lit(1).alias("side"), "term", none.cast(id_type).alias("query_id"), "path", "w")
    asked = terms.select(every(d_blocks).alias("db"), block("query_id", q_blocks).alias("qb"), F.lit(0).alias("side"), "term", "query_id", none.cast("string").alias("path"), F.col("weight").cast("double").alias("w"))
    key = (F.col("db") * q_blocks + F.col("qb")).alias("key")
    dealt = asked.unionByName(docs).select(key, "side", "term", "query_id", "path", "w").repartitionById(d_blocks * q_blocks, F.col("key")).sortWithinPartitions("side")
    local = dealt.mapInArrow(_block_scores(k), f"query_id {id_type}, path string, score double")
    return top(local, k)


def _block_scores(k: int):
    """The k best documents of a block for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        q, d = t.filter(pc.equal(t["side"], 0)), t.filter(pc.equal(t["side"], 1))
        if not q.num_rows or not d.num_rows:
            return
        words = d["term"].combine_chunks().dictionary_encode()
        term = words.indices.to_numpy()
        paths = d["path"].combine_chunks().dictionary_encode()
        order = np.argsort(term, kind="stable")
        doc, w = paths.indices.to_numpy()[order], d["w"].to_numpy()[order]
        start = np.r_[0, np.cumsum(np.bincount(term, minlength=len(words.dictionary)))]
        ids = q["query_id"].combine_chunks().dictionary_encode()
        asked = ids.indices.to_numpy()
        at = pc.index_in(q["term"].combine_chunks(), words.dictionary)
        there = np.nonzero(at.is_valid().to_numpy(zero_copy_only=False))[0]
        at, asked, weight = at.fill_null(0).to_numpy()[there], asked[there], q["w"].to_numpy()[there]
        by = np.argsort(asked, kind="stable")
        out_q, out_d, out_s = [], [], []
        n = len(paths.dictionary)
        ends = np.r_[np.nonzero(np.diff(asked[by]))[0] + 1, len(by)]
        lo = 0
        for hi in ends.tolist():
            mine = by[lo:hi]
            lo = hi
            if not len(mine):
                continue
            score = np.zeros(n)
            for i in mine.tolist():
                a, b = start[at[i]], start[at[i] + 1]
                score[doc[a:b]] += weight[i] * w[a:b]
            floor = np.partition(score, -k)[-k] - 1e-6 if n > k else 0
            best = np.nonzero((score > 0) & (score >= floor))[0]
            out_q.append(np.full(len(best), asked[mine[0]]))
            out_d.append(best)
            out_s.append(score[best])
        if out_q:
            yield pa.RecordBatch.from_arrays(
                [ids.dictionary.take(pa.array(np.concatenate(out_q))), paths.dictionary.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))], names=["query_id", "path", "score"]
            )

    return run


def _scan(chunks: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    """Chunks with the count of each query word as a substring of the body in lower case, as columns w0, w1..."""
    spark = chunks.sparkSession
    words = spark.range(1).select(X.query_words(F.lit(query)).alias("w")).first().w
    low = chunks.where(X.has_body("body")).withColumn("low", F.lower("body"))
    return low.select("*", *(X.substring_count("low", F.lit(w)).alias(f"w{i}") for i, w in enumerate(words))), words


def search_scan(chunks: DataFrame, query: str, k: int = 50, *, domain: str = "") -> DataFrame:
    """(path, score, rank): BM25 by substrings; the statistics are those of the searched scope."""
    if domain:
        chunks = chunks.where(F.col("path").startswith(f"{domain}/"))
    rows, words = _scan(chunks, query)
    if not words:
        return chunks.sparkSession.createDataFrame([], "path string, score double, rank int")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.char_length("low")).alias("avg_dl"), *(F.count_if(F.col(f"w{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    joined = rows.join(F.broadcast(stats))
    parts = [F.when(F.col(f"w{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * saturation(F.col(f"w{i}"), F.char_length("low"), F.col("avg_dl"))).otherwise(0.0) for i in range(len(words))]
    scored = joined.select("path", sum(parts[1:], parts[0]).alias("score")).where(F.col("score") > 0)
    return _top_of_one(scored, k)


def _top_of_one(scored: DataFrame, k: int) -> DataFrame:
    best = scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "path").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def keyword_density(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(path, score, rank): occurrences of the words per character of the body."""
    rows, words = _scan(chunks, query)
    if not words:
        return chunks.sparkSession.createDataFrame([], "path string, score double, rank int")
    found = sum((F.col(f"w{i}") for i in range(1, len(words))), F.col("w0"))
    return _top_of_one(rows.select("path", (found / F.char_length("low")).alias("score")).where(F.col("score") > 0), k)


def keyword_integer(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(path, score, rank): occurrences per 10,000 characters as a whole number."""
    rows, words = _scan(chunks, query)
    if not words:
        return chunks.sparkSession.createDataFrame([], "path string, score double, rank int")
    found = sum((F.col(f"w{i}") for i in range(1, len(words))), F.col("w0"))
    return _top_of_one(rows.select("path", F.floor(found * 10000 / F.char_length("low")).cast("double").alias("score")).where(F.col("score") > 0), k)
