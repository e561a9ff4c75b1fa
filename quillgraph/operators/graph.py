"""The knowledge graph: neighbours, provenance, summaries, components and expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..scratch import Table
from .edges import EXPANSION, PROVENANCE
from .hierarchy import hierarchy, sweep, unique_ids


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, direction, other, etype, metadata): every edge from both its ends; a self-loop has two rows."""
    sides = F.array(
        F.struct(F.col("source").alias("node"), F.lit("outgoing").alias("direction"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node"), F.lit("incoming").alias("direction"), F.col("source").alias("other")),
    )
    return edges.select(F.explode(sides).alias("s"), "etype", F.coalesce("metadata", F.lit("")).alias("metadata")).select("s.*", "etype", "metadata")


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """(direction, node, etype, metadata) of one node; names are compared exactly."""
    near = edges.where((F.col("source") == node) | (F.col("target") == node))
    return adjacency(near).where(F.col("node") == node).select("direction", F.col("other").alias("node"), "etype", "metadata")


def first_parents(edges: DataFrame) -> DataFrame:
    """(node, parent, etype): the first provenance edge of each node by ``seq``."""
    e = edges.where(F.col("etype").isin(*PROVENANCE))
    return e.groupBy(F.col("source").alias("node")).agg(F.min_by(F.struct("target", "etype"), "seq").alias("p")).select("node", F.col("p.target").alias("parent"), "p.etype")


def trace(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, step, node, parent, etype): the provenance chain of each node of ``starts`` (node), a stated set.

    Every step follows the first provenance edge. The chain ends with a row of type 'origin' and a
    null parent; on a cycle it ends before the node that would come again, without an origin. One
    join a step over the starts still under way; for all nodes of a store take ``trace_all``.
    """
    parents = Table(first_parents(edges), "parents").df
    front = starts.select(F.col("node").alias("start"), "node", F.array().cast("array<string>").alias("seen")).distinct()
    done: list[DataFrame] = []
    while True:
        walked = front.join(parents, "node", "left").withColumn("seen", F.array_append("seen", F.col("node")))
        now = Table(walked.select("start", F.lit(len(done)).alias("step"), "node", "parent", F.coalesce("etype", F.lit("origin")).alias("etype"), "seen"), "trace").df
        done.append(now.drop("seen"))
        front = now.where(F.col("parent").isNotNull() & ~F.array_contains("seen", F.col("parent"))).select("start", F.col("parent").alias("node"), "seen")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, done)


def trace_all(edges: DataFrame) -> DataFrame:
    """(start, step, node, parent, etype): ``trace`` of every node with a provenance edge whose way ends, from the nested-set ranges of the hierarchy."""
    parents = Table(first_parents(edges), "parents").df
    tree = Table(hierarchy(parents.select("node", "parent")), "tree").df
    up = sweep(tree, pairs=True).select(F.col("node").alias("start"), F.col("distance").alias("step"), F.col("ancestor").alias("node"))
    own = tree.where(~F.col("cyclic") & F.col("parent").isNotNull()).select(F.col("node").alias("start"), F.lit(0).alias("step"), "node")
    rows = own.unionByName(up).join(parents, "node", "left")
    return rows.select("start", "step", "node", "parent", F.coalesce("etype", F.lit("origin")).alias("etype"))


def summary(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(domains, documents, chunks, edges), one row. Domains are the distinct first segments, flat documents' names too."""
    top = F.split("path", "/")[0]
    c = chunks.where(~X.is_synthesis("path") & X.is_numbered("path")).agg(
        F.count_distinct(top).alias("domains"), F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("documents"), F.count_distinct("path").alias("chunks")
    )
    return c.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def edge_types(edges: DataFrame) -> DataFrame:
    """(etype, n)."""
    return edges.groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


def components(pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """(component, path, size): connected components of pairs (a, b) with at least ``min_size`` members.

    The component is named by its smallest path. Labels move along edges and then jump to the label
    of their label, so the rounds are logarithmic in the diameter for all but contrived graphs. Paths
    are numbered by hashes that no two share while the labels move; each round is a table in the
    shared folder. Pairs with a null end are left out.
    """
    both = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").alias("node"), F.col("b").alias("parent"))
    named, held = unique_ids(both)
    links = Table(named.select("id", "pid").unionByName(named.select(F.col("pid").alias("id"), F.col("id").alias("pid"))).distinct(), "links")
    label = Table(links.df.groupBy("id").agg(F.least(F.col("id"), F.min("pid")).alias("label")), "labels")
    while True:
        now = label.df
        near = links.df.join(now.select(F.col("id").alias("pid"), "label"), "pid").groupBy("id").agg(F.min("label").alias("near"))
        moved = now.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = now.select(F.col("id").alias("new"), F.col("label").alias("beyond"))
        least = F.least("new", F.coalesce("beyond", "new"))
        new = Table(moved.join(jump, "new", "left").select("id", least.alias("label"), (least != F.col("label")).alias("changed")), "labels")
        changed = not new.df.where("changed").isEmpty()
        label.drop()
        label = new
        if not changed:
            break
    names = named.select("id", F.col("node").alias("path")).unionByName(named.select(F.col("pid").alias("id"), F.col("parent").alias("path"))).distinct()
    members = Table(label.df.join(names, "id").select("label", "path"), "members").df
    for t in (held, links, label):
        t.drop()
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("component")).where(F.col("size") >= min_size)
    return members.join(sizes, "label").select("component", "path", "size")


def cluster_names(found: DataFrame) -> DataFrame:
    """(component, name): the synthesis node of each component, named by a hash of its sorted members.

    The members of one component are gathered in one row, as its name is a hash of all of them.
    """
    members = found.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("m"))
    return members.select("component", F.concat(F.lit("_synthesis/_synth_"), X.short_hash("m"), F.lit(".txt")).alias("name"))


def expand(results: DataFrame, edges: DataFrame, chunks: DataFrame, *, parents: int = 5, factor: float = 0.8, types: tuple[str, ...] = EXPANSION, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, path, score, rank): what the first results point to, with ``factor`` of the parent's score.

    ``results``: (*by, path, score, rank). Targets must be existing chunks that are no results; the
    first parent by rank, then edge by ``seq``, counts. Ranks go on behind those of the results.
    """
    keys = list(by)
    first = results.where(F.col("rank") <= parents).select(*keys, F.col("path").alias("source"), "score", "rank")
    out = edges.where(F.col("etype").isin(*types)).select("source", "target", "seq")
    hit = first.join(out, "source").select(*keys, F.col("target").alias("path"), (F.col("score") * factor).alias("score"), "rank", "seq")
    new = hit.join(results.select(*keys, "path"), [*keys, "path"], "left_anti").join(chunks.select("path"), "path", "left_semi")
    best = new.groupBy(*keys, "path").agg(F.min_by("score", F.struct("rank", "seq")).alias("score"), F.min(F.struct("rank", "seq")).alias("o"))
    last = results.groupBy(*keys).agg(F.max("rank").alias("last")) if keys else results.agg(F.max("rank").alias("last"))
    joined = best.join(last, keys) if keys else best.join(F.broadcast(last))
    return joined.select(*keys, "path", "score", (F.col("last") + F.row_number().over(Window.partitionBy(*keys).orderBy("o", "path"))).alias("rank"))
