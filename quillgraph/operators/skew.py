"""Joins whose keys may be hot: keys that many rows share are spread over as many salts as their rows need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to a task together, and most keys that are spread. Where more keys than that
#: had ``HOT_ROWS`` rows, the rows of a salt grow instead: a key left whole holds at most total / MAX_HOT rows.
HOT_ROWS, MAX_HOT = 50_000, 100_000


def hot_keys(counts: DataFrame, total: int) -> list[tuple[int, int]]:
    """(key hash, salts) of the hot keys of counts (h, n) that add up to ``total`` rows; at most MAX_HOT by their sizes."""
    floor = max(HOT_ROWS, -(-total // MAX_HOT))
    if total < floor:
        return []
    return [(r.h, -(-r.n // floor)) for r in counts.where(F.col("n") >= floor).select("h", "n").collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: list[tuple[int, int]], how: str = "inner", *, row: Sequence[Column | str]) -> DataFrame:
    """left join right on the keys, with the left rows of hot keys spread by a hash of the columns ``row``.

    ``right`` has few rows for each key: they are repeated once per salt, all together at most left's
    rows / HOT_ROWS + MAX_HOT times.
    """
    keys = list(keys)
    if not hot:
        return left.join(right, keys, how)
    salts = F.broadcast(left.sparkSession.createDataFrame(hot, "_h long, _salts int"))
    h = F.xxhash64(*keys)
    many = F.coalesce("_salts", F.lit(1))
    spread = left.withColumn("_h", h).join(salts, "_h", "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), *row), many).cast("int")).drop("_h", "_salts")
    held = right.withColumn("_h", h).join(salts, "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_h", "_salts")
    return spread.join(held, [*keys, "_salt"], how).drop("_salt")
