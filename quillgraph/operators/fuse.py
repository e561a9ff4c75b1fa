"""Fusing and reranking of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Constant of reciprocal rank fusion; shares of the fused and the reranker's score (fixed values).
RRF_K, FUSED_SHARE, RERANK_SHARE = 60, 0.4, 0.6


def rrf(lists: Sequence[DataFrame], *, k: int = RRF_K, weights: Sequence[float] | None = None, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(*by, path, score, rank): reciprocal rank fusion of lists (*by, path, rank).

    A path scores the sum of weight / (k + rank) over the lists; a path that a list holds twice
    counts twice. Ties go to the first appearance: list, then rank, then path.
    """
    if not lists:
        raise ValueError("no lists")
    weights = list(weights or [1.0] * len(lists))
    if len(weights) != len(lists):
        raise ValueError("one weight for each list")
    rows = [x.select(*by, "path", "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("list")) for i, (x, w) in enumerate(zip(lists, weights))]
    all_ = reduce(DataFrame.unionByName, rows)
    fused = all_.groupBy(*by, "path").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "seen", "path")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select(*by, "path", "score", "rank")


def overlap_scorer(query: Column, content: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct words that the content has."""
    from ..functions import text as X

    q = F.array_distinct(X.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, X.tokens(content))), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, *, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(*by, path, score, reranker, rank): candidates (*by, query, path, score, content) reordered.

    The scorer's values are scaled to 0..1 over the candidates of a query (all 0 where they are
    equal), the fused scores divided by their maximum; the new score is 0.4 of the one and 0.6 of
    the other. Without a scorer the order stays.
    """
    w = Window.partitionBy(*by)
    if scorer is None:
        rows = candidates.withColumn("reranker", F.lit(None).cast("double"))
    else:
        rows = candidates.withColumn("_ce", scorer(F.col("query"), F.col("content")))
        low, high, best = F.min("_ce").over(w), F.max("_ce").over(w), F.max("score").over(w)
        scaled = (F.col("_ce") - low) / F.when(high > low, high - low).otherwise(1.0)
        rows = rows.withColumn("reranker", scaled).withColumn("_new", FUSED_SHARE * F.when(best > 0, F.col("score") / best).otherwise(0.0) + RERANK_SHARE * F.col("reranker")).withColumn("score", F.col("_new"))
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 12)), "path")))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select(*by, "path", "score", "reranker", "rank")


def explain(results: DataFrame, parts: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Results with ``explain``, a map of each part's score of the path, 0 where it has none; 6 digits."""
    keys = [*by, "path"]
    for name, scores in parts.items():
        results = results.join(scores.select(*keys, F.col("score").alias(f"_{name}")), keys, "left")
    entries = [c for name in parts for c in (F.lit(name), F.round(F.coalesce(F.col(f"_{name}"), F.lit(0.0)), 6))]
    return results.withColumn("explain", F.create_map(*entries)).drop(*(f"_{n}" for n in parts))
