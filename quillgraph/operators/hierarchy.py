"""Parent-child links as numbered hierarchies.

Trees are of unknown depth and one parent may have a third of all rows, so nothing here walks level
by level or gathers the children of a parent. Leaves are counted in at their parents at once; only
nodes with children go through the rounds, some log2(depth) of them:

* upward, subtree sizes: a node under way keeps a pointer to its 2^k-th ancestor and its size within
  2^k steps. A round adds the sizes of the nodes that point to a node, and doubles the pointers. Nodes
  whose pointer passes a root are done and leave the table of those under way. When a round ends none,
  those left are on a cycle or lead into one.
* downward, preorder ranges: siblings get consecutive ranges in the order of their names by a prefix
  sum of subtree sizes over all nodes in (parent, name) order, range-partitioned, with one carry per
  partition. A node's number is the sum of the offsets on its way up, again by doubling; done nodes
  leave. Leaves follow from their parents in one join.
* nested-set ranges: ancestors and descendants of a node are told by its range. Depth is the number
  of ranges open at a node, and the root the last root before it, both by a prefix sum in preorder.

Nodes are told apart by 64-bit hashes; the names are hashed a second time to prove that no two names
share one, and another seed is taken if they do. Each round is a table in the shared folder, deleted
when the next is there. Joins to a parent that many nodes share spread those nodes over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Table
from . import skew
from .edges import PROVENANCE, valid_edges
from .prefix import prefix_sums

#: Preorder numbers of a range: nodes that one task takes through a prefix sum or a sweep at once.
RANGE = 100_000
#: So many nodes under way or fewer (some MB) go through their last rounds in one task instead of in jobs of their own.
LAST = 1 << 18


def provenance_parents(edges: DataFrame) -> DataFrame:
    """(node, parent): the target of each node's valid provenance edge of smallest ``seq``."""
    e = valid_edges(edges).where(F.col("etype").isin(*PROVENANCE))
    return e.groupBy(F.col("source").alias("node")).agg(F.min_by("target", "seq").alias("parent"))


def unique_ids(links: DataFrame) -> tuple[DataFrame, Table]:
    """(id, pid, node, parent) in a table, with ids that no two names share."""
    for seed in range(3, 100):
        h = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        table = Table(links.select(h("node").alias("id"), h("parent").alias("pid"), "node", "parent"), "links")
        names = F.array(F.struct(F.col("id"), F.xxhash64("node").alias("x")), F.struct(F.col("pid").alias("id"), F.xxhash64("parent").alias("x")))
        both = table.df.select(F.explode(names).alias("s")).select("s.*")
        clash = both.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).where(F.col("a") != F.col("b"))
        if clash.isEmpty():
            return table.df, table
        table.drop()
    raise RuntimeError("no seed tells all names apart")


def _hot(counts: DataFrame, total: int) -> list[tuple[int, int]]:
    """The hot keys of counts (up, n), as ``skew`` wants them."""
    return skew.hot_keys(counts.select(F.xxhash64("up").alias("h"), "n"), total)


def _together(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def _at(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the wanted ids among the sorted ids, which of them are there)."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _last_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, more, lost) from all (id, up, size) under way: what their further rounds add to each node, and who never ends."""
    rows = _together(batches)
    if rows is None:
        return
    rows = rows.sort_values("id")
    ids, up, size = (rows[c].to_numpy() for c in ("id", "up", "size"))
    while True:
        keys, of = np.unique(up, return_inverse=True)
        more = np.zeros(len(keys), np.int64)
        np.add.at(more, of, size)
        yield pd.DataFrame({"id": keys, "more": more, "lost": False})
        at, there = _at(keys, ids)
        size = size + np.where(there, more[at], 0)
        at, on = _at(ids, up)
        if on.all():
            yield pd.DataFrame({"id": ids, "more": 0, "lost": True})
            return
        ids, up, size = ids[on], up[at[on]], size[on]
        if not len(ids):
            return


def _last_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, pid, size, pre) of the nodes under way, from these (id, pid, up, size, pre, under) and the known ones that they point to (not under)."""
    rows = _together(batches)
    if rows is None:
        return
    rows = rows.sort_values("id")
    ids, pre, under = rows["id"].to_numpy(), rows["pre"].to_numpy(copy=True), rows["under"].to_numpy()
    at = np.arange(len(ids))
    at[under], there = _at(ids, rows["up"].to_numpy()[under])
    if not there.all():
        raise RuntimeError("a node points to none")
    on = under.copy()
    while on.any():
        to = at[on]
        pre[on] = pre[on] + pre[to]
        at[on], on[on] = at[to], on[to]
    yield rows[["id", "pid", "size"]].assign(pre=pre)[under]


def _last_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, name) from all (id, pid, node) that lead into cycles: the smallest name on the cycle."""
    rows = _together(batches)
    if rows is None:
        return
    rows = rows.sort_values("id")
    ids = rows["id"].to_numpy()
    to = _at(ids, rows["pid"].to_numpy())[0]
    end, least = to, np.empty(len(ids), np.int64)
    names = rows["node"].to_numpy(object)
    order = np.argsort(names, kind="stable")
    least[order] = np.arange(len(ids))
    for _ in range(int(len(ids)).bit_length()):  # 2^rounds steps reach a cycle and go all around it
        end = end[end]
    far, low = to, least
    for _ in range(int(len(ids)).bit_length()):
        low, far = np.minimum(low, low[far]), far[far]
    yield pd.DataFrame({"id": ids, "name": names[order[low[end]]]})


def _sizes(parents: DataFrame, gained: Table) -> tuple[DataFrame, DataFrame | None, list[Table]]:
    """(id, size) of the nodes with children, (id) of those that never reach a root or None, and the tables that hold them.

    ``parents``: (id, up) of nodes with a parent that have children; ``gained``: (up, n, more) of all
    parents, how many children and how many of them are leaves.
    """
    start = parents.join(gained.df.select(F.col("up").alias("id"), (F.col("more") + 1).alias("size")), "id")
    now, logs, was, lost = Table(start.select("id", "up", "size"), "climb"), [], None, None
    left = now.df.count()
    while left and left != was:
        a = now.df
        if left <= LAST:
            last = Table(a.coalesce(1).mapInPandas(_last_sizes, "id long, more long, lost boolean"), "gained")
            logs.append(last)
            lost = last.df.where("lost").select("id")
            left = lost.count()
            break
        log = Table(a.groupBy("up").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("more")), "gained")
        logs.append(log)
        sized = a.join(log.df.select(F.col("up").alias("id"), "more"), "id", "left").select("id", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        at = a.select(F.col("id").alias("up"), F.col("up").alias("next"))  # none for roots and done nodes
        moved = skew.spread_join(sized, at, ["up"], _hot(log.df, left), row=["id"])
        new = Table(moved.select("id", F.col("next").alias("up"), "size"), "climb")
        now.drop()
        now, was, left = new, left, new.df.count()
    every = [gained.df.select(F.col("up").alias("id"), (F.col("more") + 1).alias("size")), *(x.df.select(F.col(x.df.columns[0]).alias("id"), F.col("more").alias("size")) for x in logs)]
    both = every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum("size").alias("size")), ((now.df.select("id") if lost is None else lost) if left else None), [now, *logs]


def _sibling_offsets(tree: DataFrame) -> tuple[DataFrame, Table]:
    """(id, pid, size, offset): the sizes of the siblings before a node, in the order of their names.

    ``tree``: (id, pid, node, size); roots, whose pid is null, are each other's siblings.
    """
    rows = tree.select("id", F.col("pid").isNull().alias("top"), F.coalesce("pid", F.lit(0)).alias("key"), "node", "size")
    summed, t = prefix_sums(rows, ["top", "key"], ["node"], "size", ["id"])
    return summed.select("id", F.when(~F.col("top"), F.col("key")).alias("pid"), "size", F.col("before").alias("offset")), t


def _descend(offsets: DataFrame, gained: DataFrame, n: int) -> tuple[DataFrame, list[Table]]:
    """(id, pid, size, pre): preorder numbers, from 0, roots one after another."""
    inner = offsets.where((F.col("size") > 1) | F.col("pid").isNull())
    done = [Table(inner.where(F.col("pid").isNull()).select("id", "pid", "size", F.col("offset").alias("pre")), "numbered")]
    under = Table(inner.where(F.col("pid").isNotNull()).select("id", "pid", F.col("pid").alias("up"), "size", (F.col("offset") + 1).alias("pre")), "descend")
    while left := under.df.count():
        s = under.df
        known = done[0].df
        for t in done[1:]:
            known = known.unionByName(t.df)
        if left <= LAST:
            of = known.join(F.broadcast(s.select(F.col("up").alias("id")).distinct()), "id", "left_semi")  # at most LAST
            none = F.lit(0).cast("long")  # no nulls: pandas would make the ids floating-point numbers
            both = s.select("id", "pid", "up", "size", "pre", F.lit(True).alias("under")).unionByName(of.select("id", none.alias("pid"), none.alias("up"), "size", "pre", F.lit(False).alias("under")))
            done.append(Table(both.coalesce(1).mapInPandas(_last_numbers, "id long, pid long, size long, pre long"), "numbered"))
            break
        at = known.select(F.col("id").alias("up"), F.lit(None).cast("long").alias("next"), F.col("pre").alias("more")).unionByName(
            s.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("pre").alias("more"))
        )
        hot = _hot(s.groupBy("up").agg(F.count(F.lit(1)).alias("n")), left)
        moved = skew.spread_join(s, at, ["up"], hot, row=["id"]).select("id", "pid", F.col("next").alias("up"), "size", (F.col("pre") + F.col("more")).alias("pre"))
        new = Table(moved, "descend")
        done.append(Table(new.df.where(F.col("up").isNull()).select("id", "pid", "size", "pre"), "numbered"))
        under.drop()
        under = Table(new.df.where(F.col("up").isNotNull()), "descend")
        new.drop()
    under.drop()
    known = done[0].df
    for t in done[1:]:
        known = known.unionByName(t.df)
    leaf = offsets.where((F.col("size") == 1) & F.col("pid").isNotNull())
    hot = _hot(gained, n)
    found = skew.spread_join(leaf, known.select(F.col("id").alias("pid"), F.col("pre").alias("of")), ["pid"], hot, row=["id"])
    return known.unionByName(found.select("id", "pid", "size", (F.col("of") + 1 + F.col("offset")).alias("pre"))), done


def _open_ranges(tree: DataFrame, n: int) -> DataFrame:
    """(id, root, depth, pre, size): by a prefix sum in preorder, depth as the ranges open at a node, root as the last root before it.

    ``tree``: (id, pre, size, name), name only of roots. Ranges of RANGE numbers are summed on their
    own and start from what is open at their first number, one row a range.
    """
    parts = max(1, ceil(n / RANGE))
    place = lambda c: F.least((c / RANGE).cast("int"), F.lit(parts - 1))
    inner = F.col("size") > 1
    start = F.struct(F.col("pre").alias("pos"), F.lit(1).alias("kind"), inner.cast("int").alias("w"), "name", "id", "size")
    none = F.lit(None).cast("long")
    end = F.struct((F.col("pre") + F.col("size")).alias("pos"), F.lit(0).alias("kind"), F.lit(-1).alias("w"), F.lit(None).cast("string").alias("name"), none.alias("id"), none.alias("size"))
    events = tree.select(F.explode(F.when(inner, F.array(start, end)).otherwise(F.array(start))).alias("e")).select(place(F.col("e.pos")).alias("part"), "e.*")
    w = Window.partitionBy("part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.select("*", (F.sum("w").over(w) - F.col("w")).alias("open"), F.last("name", True).over(w).alias("near"))
    if parts == 1:
        return summed.where("kind = 1").select("id", F.col("near").alias("root"), F.col("open").cast("int").alias("depth"), F.col("pos").alias("pre"), "size")
    ends = events.groupBy("part").agg(F.sum("w").alias("w"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("name"))
    every = tree.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carry = every.select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("held"), F.last("name", True).over(before).alias("top"))
    return (
        summed.where("kind = 1").join(F.broadcast(carry), "part")
        .select("id", F.coalesce("near", "top").alias("root"), (F.col("open") + F.col("held")).cast("int").alias("depth"), F.col("pos").alias("pre"), "size")
    )


def _cycles(links: DataFrame) -> tuple[DataFrame, Table]:
    """(id, name): for each node that leads into a cycle, the smallest name on it; and the table that holds it.

    ``links``: (id, pid, node), all of whose parents are nodes of it.
    """
    if links.count() <= LAST:
        made = Table(links.select("id", "pid", "node").coalesce(1).mapInPandas(_last_cycles, "id long, name string"), "loops")
        return made.df, made
    walk = Table(links.select("id", F.col("pid").alias("up")), "walk")
    count = None
    while True:
        w = walk.df
        on = w.select(F.col("up").alias("id")).distinct().count()  # the nodes still reached: only cycles in the end
        if on == count:
            break
        count = on
        new = Table(w.join(w.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "walk")
        walk.drop()
        walk = new
    on = walk.df.select(F.col("up").alias("id")).distinct()
    least = Table(links.join(on, "id", "left_semi").select("id", F.col("pid").alias("up"), F.col("node").alias("name")), "least")
    while True:
        s = least.df
        at = s.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("name").alias("other"))
        new = Table(
            s.join(at, "up").select("id", F.col("next").alias("up"), F.least("name", "other").alias("name"), (F.col("other") < F.col("name")).alias("changed")),
            "least",
        )
        changed = not new.df.where("changed").isEmpty()
        least.drop()
        least = new
        if not changed:
            made = Table(walk.df.join(least.df.select(F.col("id").alias("up"), "name"), "up").select("id", "name"), "loops")
            walk.drop()
            least.drop()
            return made.df, made


def hierarchy(links: DataFrame) -> DataFrame:
    """(node, parent, root, depth, pre, size, cyclic) for every node of the trees that the links make.

    ``links``: (node, parent), one row a node. Roots (parents without a parent) come out too, with a
    null parent and depth 0. ``pre`` numbers the nodes in preorder, roots and siblings in the order of
    their names (code points); ``size`` counts a node and its descendants, which are the nodes with
    ``pre`` in (pre, pre + size). Nodes on a cycle or leading into one are cyclic: depth -1, root the
    smallest name on the cycle (code point order), pre and size null. Links with a null node or
    parent are left out; of repeated nodes the smallest parent counts; no links give no rows.
    """
    links = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    named, held = unique_ids(links)
    tables = [held]

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(Table(df, name))
        return tables[-1].df

    children = named.groupBy(F.col("pid").alias("up"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    of = children.join(named.select(F.col("id").alias("up"), F.col("pid").alias("over")), "up", "left")
    inner = keep(of, "inner")  # the nodes with children: how many, and what is over them
    inner_children = inner.where(F.col("over").isNotNull()).groupBy(F.col("over").alias("up")).agg(F.count(F.lit(1)).alias("m"))
    gained = Table(inner.join(inner_children, "up", "left").select("up", "n", (F.col("n") - F.coalesce("m", F.lit(0))).alias("more")), "gained")
    tables.append(gained)
    sizes, lost, more = _sizes(inner.where(F.col("over").isNotNull()).select(F.col("up").alias("id"), F.col("over").alias("up")), gained)
    tables += more
    sizes = keep(sizes if lost is None else sizes.join(lost, "id", "left_anti"), "sizes")
    tops = inner.where(F.col("over").isNull()).select(F.col("up").alias("id"), F.lit(None).cast("long").alias("pid"), F.col("name").alias("node"))
    nodes = named.select("id", "pid", "node").unionByName(tops).join(sizes, "id", "left")
    if lost is not None:  # leaves below cyclic nodes too
        astray = keep(lost.unionByName(named.join(lost.select(F.col("id").alias("pid")), "pid", "left_semi").select("id")).distinct(), "astray")
        nodes = nodes.join(astray, "id", "left_anti")
    tree = keep(nodes.select("id", "pid", "node", F.coalesce("size", F.lit(1)).cast("long").alias("size")), "tree")
    n = tree.count()
    done = None
    if n:
        offsets, table = _sibling_offsets(tree)
        numbered, more = _descend(offsets, gained.df, n)
        tables += [table, *more]
        top_names = tops.select("id", F.col("node").alias("name"))
        marked = keep(numbered, "numbered")
        first = marked.where(F.col("pid").isNull()).join(top_names, "id").select("id", "pre", "size", "name")
        rest = marked.where(F.col("pid").isNotNull()).select("id", "pre", "size", F.lit(None).cast("string").alias("name"))
        told = _open_ranges(first.unionByName(rest), n)
        all_names = named.select("id", "node", "parent").unionByName(tops.select("id", "node", F.lit(None).cast("string").alias("parent")))
        done = all_names.join(told, "id").select("node", "parent", "root", "depth", "pre", "size", F.lit(False).alias("cyclic"))
    if lost is not None:
        left = keep(named.join(astray, "id", "left_semi").select("id", "pid", "node", "parent"), "cyclic")
        names, table = _cycles(left)
        tables.append(table)
        none = F.lit(None).cast("long")
        loops = left.join(names, "id").select("node", "parent", F.col("name").alias("root"), F.lit(-1).alias("depth"), none.alias("pre"), none.alias("size"), F.lit(True).alias("cyclic"))
        done = loops if done is None else done.unionByName(loops)
    if done is None:
        done = links.sparkSession.createDataFrame([], "node string, parent string, root string, depth int, pre long, size long, cyclic boolean")
    made = Table(done, "hierarchy").df
    for t in tables:
        t.drop()
    return made


def sweep(tree: DataFrame, *, pairs: bool = False) -> DataFrame:
    """Walk the nested-set ranges in preorder: full paths, or all (ancestor, node) pairs.

    Without ``pairs``: (node, path) with path the names from the root down, joined by ' > '. With:
    (ancestor, node, distance), one row for each node and ancestor. A task walks RANGE preorder
    numbers; nodes whose range goes on into later ones are sent there as well, which is one row for
    each range and node open at its first number. Cyclic nodes have no path and no pairs.
    """
    part = lambda c: F.floor(c / RANGE).cast("int")
    t = tree.where(~F.col("cyclic")).select("node", "pre", "size")
    over = part(F.col("pre") + F.col("size") - 1)
    to = F.when(over > part(F.col("pre")), F.sequence(part(F.col("pre")), over)).otherwise(F.array(part(F.col("pre"))))
    sent = t.select("node", "pre", "size", F.explode(to).alias("part")).withColumn("own", F.col("part") == part(F.col("pre")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, now = [], None
        for b in batches:
            a, n, x, out = [], [], [], []

            def made() -> pd.DataFrame:
                return pd.DataFrame({"ancestor": a, "node": n, "distance": x} if pairs else {"node": n, "path": out})

            for part, node, pre, size, own in zip(b["part"], b["node"], b["pre"], b["size"], b["own"]):
                if part != now:
                    stack, now = [], part
                while stack and stack[-1][1] <= pre:
                    stack.pop()
                if own and pairs:
                    a += [s[0] for s in stack]
                    n += [node] * len(stack)
                    x += range(len(stack), 0, -1)
                elif own:
                    n.append(node)
                    out.append(" > ".join([*(s[0] for s in stack), node]))
                stack.append((node, pre + size))
                if len(n) > 50_000:
                    yield made()
                    a, n, x, out = [], [], [], []
            yield made()

    whole = sent.repartition("part").sortWithinPartitions("part", "pre")
    return whole.mapInPandas(run, "ancestor string, node string, distance int" if pairs else "node string, path string")
