"""Incremental ingest and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def distinct_texts(stream: DataFrame, *, text: str = "text", at: str = "added_at", delay: str | None = None) -> DataFrame:
    """The first row of each text of a stream (or a batch), by a hash of the text.

    With ``delay`` texts are remembered only so long behind the watermark; without, for ever.
    """
    rows = stream.where(F.col(text).isNotNull()).withColumn("text_hash", F.sha2(text, 256)).withColumn(at, F.col(at).cast("timestamp"))
    if delay is None:
        return rows.dropDuplicates(["text_hash"])
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["text_hash"])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, events, value): sessions of users; late rows beyond ``delay`` are dropped on a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    s = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "value")


def ingest(stream: DataFrame, store, checkpoint: str, *, domain: str | None = None, once: bool = True):
    """Feed a stream of sources (path, content as bytes or text) into a store, each micro-batch in one change.

    A batch that comes again after a failure finds its sources in the ledger and is skipped.
    """

    def batch(rows: DataFrame, _: int) -> None:
        store.add_sources(rows.select("path", F.col("content").cast("binary").alias("content")), domain)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_terms(stream: DataFrame, *, text: str = "text") -> DataFrame:
    """(term, df): how many texts of a stream hold each term, in 'complete' or 'update' mode."""
    return stream.select(F.explode(F.array_distinct(X.tokens(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
