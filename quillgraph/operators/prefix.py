"""Running sums within groups of any size, over range partitions with one carry for each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Table


def prefix_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, keep: Sequence[str]) -> tuple[DataFrame, Table]:
    """(*group, *keep, value, before): before is the sum of ``value`` over the rows that come earlier in the group; and the table that holds it.

    Rows are range-partitioned by group and order, so that a group of any size is spread; each
    partition sums on its own and gets what its first group has in the partitions before, one row a
    partition. ``rows`` are read twice (a table, not a plan of its own); group, keep and value hold no nulls.
    """
    group, keep = list(group), list(keep)
    by = [*group, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total, row = None, 0, 0
        for b in batches:
            if not len(b):
                continue
            n = b[value].to_numpy()
            keys = [b[g].to_numpy() for g in group]
            first = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            ends = np.cumsum(n)
            starts = np.nonzero(first)[0]
            before = ends - n - np.repeat(ends[starts] - n[starts], np.diff(np.r_[starts, len(n)]))
            if last == [k[0] for k in keys]:
                before[: starts[1] if len(starts) > 1 else len(n)] += total
            yield pd.DataFrame({"_part": part, "_row": np.arange(row, row + len(n)), **{c: b[c] for c in (*group, *keep)}, value: n, "before": before})
            last, total, row = [k[-1] for k in keys], int(before[-1] + n[-1]), row + len(n)

    types = {f.name: f for f in rows.schema}
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), *(types[c] for c in (*group, *keep)), T.StructField(value, T.LongType()), T.StructField("before", T.LongType())]
    )
    columns = list(dict.fromkeys([*group, *keep, value]))
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*columns)
    t = Table(spread.mapInPandas(run, schema), "prefix")
    key = F.struct(*group)
    ends = t.df.groupBy("_part").agg(F.min_by(key, "_row").alias("lo"), F.max_by(key, "_row").alias("hi"), F.max_by(F.col("before") + F.col(value), "_row").alias("tail"))
    carry, hi, total = [], None, 0
    for r in ends.orderBy("_part").collect():  # one row a partition
        carried = total if r.lo == hi else 0
        carry.append((r._part, carried, r.lo))
        total = r.tail + (carried if r.lo == r.hi else 0)
        hi = r.hi
    low = F.broadcast(rows.sparkSession.createDataFrame(carry, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_carry", T.LongType()), T.StructField("_lo", T.StructType([types[g] for g in group]))])))
    before = F.col("before") + F.when(key == F.col("_lo"), F.col("_carry")).otherwise(0)
    return t.df.join(low, "_part").select(*group, *keep, value, before.alias("before")), t
