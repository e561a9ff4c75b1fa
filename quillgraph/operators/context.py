"""Context of an answer: what fits into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def block(path: Column, score: Column, content: Column) -> Column:
    """One source of a context with its header line."""
    return F.concat(F.format_string("--- Source: %s (score: %.4f) ---\n", path, score), content)


def within_budget(results: DataFrame, max_tokens: int = 8000, by: tuple[str, ...] = ()) -> DataFrame:
    """Results (*by, path, score, rank, content) with ``tokens`` and ``used``, up to the first that overflows the budget."""
    w = Window.partitionBy(*by).orderBy("rank", "path").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("tokens", X.token_estimate("content")).withColumn("used", F.sum("tokens").over(w))
    return rows.where(F.col("used") <= max_tokens)


def assemble(results: DataFrame, max_tokens: int = 8000, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, context, sources): the blocks of the results within the budget in order of rank, and their paths."""
    fit = within_budget(results, max_tokens, by).select(*by, F.struct("rank", "path", block(F.col("path"), F.col("score"), F.col("content")).alias("b")).alias("r"))
    rows = fit.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r"))  # bounded by the budget
    return rows.select(*by, F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("context"), F.transform("r", lambda x: x["path"]).alias("sources"))


def sources_in(context: Column) -> Column:
    """The paths that the header lines of a context name."""
    return F.regexp_extract_all(context, F.lit(r"(?m)^--- Source: (.*?) \(score: [^)]*\) ---$"), F.lit(1))


def merge_attempts(attempts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Results of several attempts (*by, attempt, rank, path, score), each path once: the first attempt and rank win."""
    w = Window.partitionBy(*by, "path").orderBy("attempt", "rank")
    once = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("attempt", "rank", "path")))
