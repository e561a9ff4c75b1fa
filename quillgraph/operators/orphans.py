"""References to records that do not exist.

References are grouped by the mask of their null key columns, in one pass that also counts the rows
of each key. Every mask that occurs is matched on its non-null columns only, under the declared match
semantics:

* ``simple``: a reference with any null key column counts as satisfied,
* ``partial``: the non-null columns must agree with some record; all null counts as satisfied,
* ``full``: all null counts as satisfied, partly null never is,
* ``same``: a null is a value of its own: a record must have the same columns and the same nulls.

The match is an outer anti-join: records are reduced to one row per key (how many, how many live,
first written) before the join, so that one shuffle tells missing, deleted and late apart. Keys that
many references share are spread over salts by their counts (``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .skew import hot_keys, spread_join

MATCHES = ("simple", "partial", "full", "same")


def _mask(keys: Sequence[str]) -> Column:
    """The null key columns as bits."""
    return reduce(Column.__add__, (F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0)).cast("int")


def _match(refs: DataFrame, records: DataFrame, there: Sequence[str], hot: list[tuple[int, int]], spread: list[Column]) -> DataFrame:
    """References with n, live and first of the records that agree on the columns ``there`` (null: none)."""
    per_key = records.groupBy(*there).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("died").isNull()).alias("live"), F.min("born").alias("first"))
    return spread_join(refs, per_key, there, hot, "left", row=spread)


def find_orphans(
    refs: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    *,
    match: str = "simple",
    at: str | None = None,
    born: str | None = None,
    died: str | None = None,
) -> DataFrame:
    """The references that do not resolve, with a column ``reason``.

    ``keys`` are columns of both tables. ``at`` (of refs) is when the reference was made, ``born``
    and ``died`` (of records) when a record came and went; null: unknown, not gone. ``reason``:
    'missing' if no record has the key, else 'deleted' if every such record is gone, else 'late' if
    the first of them came after the reference; 'partial' for a partly null key under ``full``.
    Empty tables: no references give no rows, no records make every reference missing. Repeated
    references each come out. Other columns of refs stay, whatever their names, but for one named
    ``reason``, which is replaced; of records only the keys, ``born`` and ``died`` are read.
    The references are read once to count masks and keys and once for each mask that must be matched.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    stamp = lambda name: (F.col(name) if name else F.lit(None)).cast("timestamp")
    rest = [c for c in refs.columns if c != "reason" and c not in keys]
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    back = [F.col(names[c]).alias(c) if c in names else F.col("row")[c].alias(c) for c in refs.columns if c != "reason"]
    spread = [F.col("row")[c] for c, t in refs.dtypes if c in rest and "map<" not in t and "variant" not in t]
    cols = list(names.values())
    renamed = [F.col(k).alias(n) for k, n in names.items()]
    records = records.select(*renamed, stamp(born).alias("born"), stamp(died).alias("died"))
    refs = refs.select(F.struct(F.lit(1).alias("_quill"), *rest).alias("row"), *renamed, stamp(at).alias("at"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("live") == 0, "deleted").when(F.col("first") > F.col("at"), "late")
    parts = [refs.select("row", *cols, F.lit("").alias("reason")).where(F.lit(False))]
    # the hash skips nulls, so that it is that of the columns a mask is matched on
    counted = Table(refs.groupBy(_mask(cols).alias("mask"), F.xxhash64(*cols).alias("h")).agg(F.count(F.lit(1)).alias("n")), "masks")
    for mask, total in counted.df.groupBy("mask").agg(F.sum("n")).collect():  # the masks that occur, at most 2^keys
        there = [k for i, k in enumerate(cols) if not mask >> i & 1]
        group = refs.where(_mask(cols) == mask)
        if not mask or match == "same" or (match == "partial" and there):
            of = reduce(Column.__and__, (F.col(k).isNotNull() for k in there), F.lit(True))
            agree = records.where(_mask(cols) == mask) if match == "same" else records.where(of)
            if there:
                hot = hot_keys(counted.df.where(F.col("mask") == mask), total)
                found = _match(group, agree, there, hot, spread)
            else:  # all null: every such reference meets the same records, one row of them
                found = group.join(F.broadcast(agree.agg(F.expr("nullif(count(1), 0)").alias("n"), F.count_if(F.col("died").isNull()).alias("live"), F.min("born").alias("first"))))
            parts.append(found.select("row", *cols, reason.alias("reason")).where(F.col("reason").isNotNull()))
        elif match == "full" and there:
            parts.append(group.select("row", *cols, F.lit("partial").alias("reason")))
    counted.drop()
    return reduce(DataFrame.unionByName, parts).select(*back, "reason")


def edge_ends(edges: DataFrame) -> DataFrame:
    """(seq, etype, created_at, side, path): both ends of each valid edge; not the source of a ``retrieved`` edge."""
    from .edges import valid_edges

    ends = F.array(
        F.when(F.col("etype") != "retrieved", F.struct(F.lit("source").alias("side"), F.col("source").alias("path"))),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("path")),
    )
    e = valid_edges(edges).select("seq", "etype", "created_at", F.explode(ends).alias("_e"))
    return e.where(F.col("_e").isNotNull()).select("seq", "etype", "created_at", "_e.side", "_e.path")


def store_records(chunks: DataFrame, sources: DataFrame, collections: DataFrame) -> DataFrame:
    """(path, born, died) of all records that edges may name."""
    of = lambda t, born, died: t.select("path", F.col(born).alias("born"), F.col(died).alias("died"))
    return (
        of(chunks, "written_at", "deleted_at")
        .unionByName(of(sources, "scanned_at", "removed_at"))
        .unionByName(of(collections, "written_at", "deleted_at"))
    )


def path_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the composite key of ``path``: ``folder``, null for a name without one, and ``name``."""
    name = F.substring_index("path", "/", -1)
    folder = F.char_length("path") - F.char_length(name)  # with the slash
    return rows.withColumns({"folder": F.when(folder > 0, F.left("path", folder - 1)), "name": name})


def edge_orphans(edges: DataFrame, chunks: DataFrame, sources: DataFrame, collections: DataFrame) -> DataFrame:
    """(seq, etype, created_at, side, path, reason): the ends of valid edges that do not resolve.

    Paths are matched by folder and name; the folder of a top name is null, and null folders only
    meet null folders (``same``).
    """
    records = store_records(chunks, sources, collections).where(F.col("path").isNotNull())
    ends = path_keys(edge_ends(edges)).drop("path")
    found = find_orphans(ends, path_keys(records), ["folder", "name"], match="same", at="created_at", born="born", died="died")
    return found.select("seq", "etype", "created_at", "side", F.concat_ws("/", "folder", "name").alias("path"), "reason")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(etype, side, month, reason, n): ends that do not resolve; month is null where created_at is."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return orphans.groupBy("etype", "side", month, "reason").agg(F.count(F.lit(1)).alias("n"))
