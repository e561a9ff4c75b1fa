"""Quality and integrity of a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def counters(chunks: DataFrame, edges: DataFrame, embedded: DataFrame, indexed: DataFrame) -> DataFrame:
    """The counts of a store, one row.

    ``chunks``: live (path, has_provenance, stale); ``edges``: valid (source, target); ``embedded``
    and ``indexed``: (path). A document is the folder of a path; folders that begin with _ hold none.
    Domains are first segments of paths of three or more segments.
    """
    c = chunks.where(~F.col("path").startswith("_") & F.col("path").contains("/")).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("doc"), X.domain_of("path").alias("dom"), X.is_synthesis("path").alias("made"),
        X.is_numbered("path").alias("raw"), F.coalesce("has_provenance", F.lit(False)).alias("prov"), F.coalesce("stale", F.lit(False)).alias("old"),
    )
    raw = c.where("raw")
    ends = edges.select(F.explode(F.array("source", "target")).alias("p")).select(X.document_of("p").alias("doc")).distinct()
    docs = c.groupBy("doc").agg(F.max("made").alias("made"))
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(c, F.count_distinct(F.when(F.col("dom") != "", F.col("dom"))).alias("domains"), F.count_if("raw").alias("chunks"), F.count_if("made").alias("synthesis_nodes"),
            F.count_if(F.col("made") & F.col("old")).alias("stale_nodes"), F.count_if(F.col("raw") & F.col("prov")).alias("chunks_with_provenance")),
        one(docs, F.count(F.lit(1)).alias("documents"), F.count_if("made").alias("documents_with_synthesis")),
        one(docs.join(ends, "doc", "left_semi"), F.count(F.lit(1)).alias("documents_with_edges")),
        one(raw.join(embedded.select("path").distinct(), "path", "left_semi"), F.count(F.lit(1)).alias("chunks_with_embeddings")),
        one(raw.join(indexed.select("path").distinct(), "path", "left_semi"), F.count(F.lit(1)).alias("chunks_indexed")),
        one(edges, F.count(F.lit(1)).alias("edges")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


def ratios(counts: DataFrame) -> DataFrame:
    """The counts with the derived ratios and the overall score, the mean of six of them."""
    per = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.when(F.col(b) == 0, 1).otherwise(F.col(b)))
    r = counts.select(
        "*", per("chunks_with_provenance", "chunks").alias("provenance_coverage"), per("chunks_with_embeddings", "chunks").alias("embedding_coverage"),
        per("chunks_indexed", "chunks").alias("bm25_coverage"), per("edges", "documents").alias("edge_density"),
        F.when(F.col("documents") == 0, 0.0).otherwise(1 - per("documents_with_edges", "documents")).alias("orphan_rate"),
        per("documents_with_synthesis", "documents").alias("synthesis_coverage"), per("stale_nodes", "synthesis_nodes").alias("stale_rate"),
    )
    six: list[Column] = [F.col("provenance_coverage"), F.col("embedding_coverage"), F.col("bm25_coverage"), 1 - F.col("orphan_rate"), F.col("synthesis_coverage"), 1 - F.col("stale_rate")]
    return r.withColumn("overall_score", sum(six[1:], six[0]) / 6)


def dangling(edges: DataFrame, chunks: DataFrame, end: str = "source") -> DataFrame:
    """Edges whose ``end`` names a .txt file that is no chunk."""
    gone = edges.where(F.col(end).endswith(".txt")).join(chunks.select(F.col("path").alias(end)), end, "left_anti")
    return gone.select(*edges.columns)


def collect_garbage(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges without those whose source names a .txt file that is no chunk."""
    known = chunks.select(F.col("path").alias("source"), F.lit(True).alias("_k")).distinct()
    return edges.join(known, "source", "left").where(~F.col("source").endswith(".txt") | F.col("_k").isNotNull()).select(*edges.columns)


def stale_ledger(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Ledger rows (source_path) whose source file is gone."""
    return ledger.join(sources.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def verify(chunks: DataFrame, edges: DataFrame, vectors: DataFrame, sources: DataFrame, ledger: DataFrame, dims: int) -> DataFrame:
    """(finding, n): unreadable chunks, dangling edges, unusable and orphaned vectors, ledger rows without a file."""
    bad = F.col("vec").isNull() | (F.size("vec") != dims)
    found = {
        "unreadable_chunks": chunks.where(F.col("body").isNull()),
        "orphan_edges": dangling(edges, chunks),
        "unusable_vectors": vectors.where(bad),
        "orphan_vectors": vectors.join(chunks.select("path"), "path", "left_anti"),
        "stale_ledger": stale_ledger(ledger, sources),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n") for name, df in found.items()))
