"""Packing documents into context windows of fixed capacity.

Only (id, size) rows move. They are hashed into groups of some GROUP documents; each group is packed
on its own, so that the only loss of grouping is one open window a group. Within a group documents
go best-fit decreasing, then a local search raises the sum of squared fills: documents move to
fuller windows, and underfull windows exchange documents, one for one, two for one or one for two,
whenever that leaves the fuller of both fuller. Every change raises the sum, so the search ends by
itself, when no window can give away a document and no exchange is left; windows that are emptied
on the way vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a group.
GROUP = 20_000


class _Bins:
    """Windows with their items, and where items of each size lie."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[set[int]] = []
        self.fill: list[int] = []
        self.of = [-1] * len(sizes)
        self.version: list[int] = []  # counts a bin's changes
        self.free: list[set[int]] = [set() for _ in range(capacity + 1)]  # bins by free space
        self.mask = 0  # bit f: some bin has f free

    def _place(self, b: int, old: int, new: int) -> None:
        c = self.capacity
        if old >= 0:
            self.free[c - old].discard(b)
            if not self.free[c - old]:
                self.mask &= ~(1 << (c - old))
        self.free[c - new].add(b)
        self.mask |= 1 << (c - new)

    def add(self, i: int, b: int) -> None:
        s = int(self.sizes[i])
        self.items[b].add(i)
        self.of[i] = b
        self._place(b, self.fill[b], self.fill[b] + s)
        self.fill[b] += s
        self.version[b] += 1

    def take(self, i: int) -> int:
        b, s = self.of[i], int(self.sizes[i])
        self.items[b].discard(i)
        self._place(b, self.fill[b], self.fill[b] - s)
        self.fill[b] -= s
        self.version[b] += 1
        return b

    def open(self) -> int:
        self.items.append(set())
        self.fill.append(0)
        self.version.append(0)
        self._place(len(self.fill) - 1, -1, 0)
        return len(self.fill) - 1

    def best_fit(self, size: int, but: int = -1) -> int:
        """The fullest bin that takes the size, -1 if none does."""
        m = self.mask >> size
        while m:
            low = (m & -m).bit_length() - 1
            for b in self.free[size + low]:
                if b != but:
                    return b
            m &= m - 1
        return -1

class _Offers:
    """What the underfull bins could give, as it was when a round began: items, or pairs of items of one bin.

    Sorted by size; of one size the emptiest bin comes first. An offer holds as long as its bin is unchanged.
    """

    def __init__(self, bins: _Bins, size: np.ndarray, bin_: np.ndarray, items: np.ndarray):
        order = np.lexsort((np.array(bins.fill, np.int64)[bin_], size)) if len(size) else np.zeros(0, np.int64)
        self.size, self.bin, self.items = size[order], bin_[order].tolist(), items[order]
        self.sizes, first = np.unique(self.size, return_index=True)
        self.first = np.r_[first, len(self.size)].tolist()
        self.version = [bins.version[b] for b in self.bin]

    def best(self, bins: _Bins, b: int, out: np.ndarray, gap: int) -> tuple[int, int, np.ndarray] | None:
        """(gain, place in ``out``, items) of the offer larger than out[place] by the most, within the gap of b, from a bin that is less full than b becomes."""
        if not len(self.sizes) or not len(out):
            return None
        high = np.searchsorted(self.sizes, out + gap, "right") - 1
        gain = np.where(high >= 0, self.sizes[high] - out, 0)
        found = None
        for place in np.argsort(-gain, kind="stable").tolist():
            if gain[place] <= (found[0] if found else 0):
                break
            at, own = int(high[place]), int(out[place])
            while at >= 0 and self.sizes[at] - own > (found[0] if found else 0):
                more = int(self.sizes[at]) - own
                for k in range(self.first[at], self.first[at + 1]):
                    a = self.bin[k]
                    if bins.version[a] != self.version[k]:
                        continue
                    if bins.fill[a] >= bins.fill[b] + more:
                        break  # all others of the size lie in fuller bins
                    if a != b:
                        found = (more, place, self.items[k])
                        break
                else:
                    at -= 1
                    continue
                if found and found[0] == more:
                    break
                at -= 1
        return found


def _pairs(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs of the items, one of each sum."""
    i, j = np.triu_indices(len(items), 1)
    _, once = np.unique(sizes[items[i]] + sizes[items[j]], return_index=True)
    return np.stack([items[i[once]], items[j[once]]], 1)


def _improve(bins: _Bins) -> bool:
    """One round of local search; every change raises the sum of squared fills."""
    changed, sizes, cap = False, bins.sizes, bins.capacity
    under = lambda: [b for b, f in enumerate(bins.fill) if 0 < f < cap]
    for b in sorted(under(), key=lambda b: bins.fill[b]):  # empty the least filled first: its items move to fuller bins
        for i in sorted(bins.items[b], key=lambda i: -sizes[i]):
            to = bins.best_fit(int(sizes[i]), b)
            if to >= 0 and bins.fill[to] > bins.fill[b] - sizes[i]:
                bins.take(i)
                bins.add(i, to)
                changed = True
    open_ = under()
    of = [sorted(bins.items[b]) for b in open_]
    items = np.array([i for x in of for i in x], np.int64)
    where = np.repeat(np.array(open_, np.int64), [len(x) for x in of])
    singles = _Offers(bins, sizes[items], where, items[:, None])
    pair, place = [], []
    for b, x in zip(open_, of):
        if len(x) > 1:
            pair.append(_pairs(np.array(x), sizes))
            place.append(np.full(len(pair[-1]), b, np.int64))
    pairs = np.concatenate(pair) if pair else np.zeros((0, 2), np.int64)
    doubles = _Offers(bins, sizes[pairs].sum(1), np.concatenate(place) if place else np.zeros(0, np.int64), pairs)
    for b in sorted(open_, key=lambda b: -bins.fill[b]):
        while 0 < bins.fill[b] < cap:
            gap = cap - bins.fill[b]
            mine = np.array(sorted(bins.items[b]))
            _, once = np.unique(sizes[mine], return_index=True)
            one, two = mine[once][:, None], _pairs(mine, sizes)
            trials = [(one, singles), (two, singles), (one, doubles)]
            best, swap = 0, None
            for out, offers in trials:
                got = offers.best(bins, b, sizes[out].sum(1), gap)
                if got and got[0] > best:
                    best, swap = got[0], (out[got[1]].tolist(), got[2].tolist())
                if best == gap:
                    break
            if swap is None:
                break
            a = bins.of[swap[1][0]]
            for i in swap[0]:
                bins.take(i)
            for i in swap[1]:
                bins.take(i)
                bins.add(i, b)
            for i in swap[0]:
                bins.add(i, a)
            changed = True
    return changed


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item. Items are 0..capacity; those of size 0 go to window 0."""
    bins = _Bins(sizes, capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        if sizes[i] == 0:
            break
        b = bins.best_fit(int(sizes[i]))
        bins.add(i, bins.open() if b < 0 else b)
    while _improve(bins):
        pass
    used = {b: n for n, b in enumerate(b for b, f in enumerate(bins.fill) if f)}
    return np.array([used.get(b, 0) for b in bins.of], np.int64)


def pack_documents(documents: DataFrame, capacity: int, size: Column, *, id: str = "doc_id") -> DataFrame:
    """(window, doc_id, piece, token_from, token_to, pieces): documents assigned to windows of ``capacity`` tokens.

    A document of at most ``capacity`` tokens lies whole in one window (piece 0 of 1). A larger one
    is cut into full windows and a rest, token ranges [token_from, token_to). Documents of size 0
    (null or blank) are assigned to a window and take no room; null sizes count as 0. Repeated rows
    are items of their own; an empty table gives no rows; extra columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = documents.select(F.col(id).alias("doc_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size")).withColumn("doc_id", F.col("doc_id").cast("long"))
    groups = max(1, ceil(items.select("doc_id").count() / GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("size", "ascending")])
        sizes = rows["size"].to_numpy()
        n = np.maximum(1, -(-sizes // capacity))
        at = np.repeat(np.arange(len(sizes)), n)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        stop = np.minimum(start + capacity, sizes[at])
        window = (TaskContext.get().partitionId() << 40) + pack(stop - start, capacity)
        ids = rows["doc_id"].combine_chunks().take(pa.array(at))  # Arrow keeps null ids and large ones as they are
        columns = [pa.array(window), ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop), pa.array(n[at].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["window", "doc_id", "piece", "token_from", "token_to", "pieces"])

    # rows without an id are spread by their place in the input
    where = F.pmod(F.xxhash64(F.lit(6), F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())), F.lit(groups)).cast("int")
    spread = items.withColumn("_group", where).repartitionById(groups, F.col("_group")).drop("_group")
    return spread.mapInArrow(run, "window long, doc_id long, piece int, token_from long, token_to long, pieces int")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(windows, documents, split_documents, tokens, fill): how full the windows are, in one row."""
    tokens = F.sum(F.col("token_to") - F.col("token_from"))
    windows = F.count_distinct("window")
    return packed.agg(
        windows.alias("windows"),
        F.count_if(F.col("piece") == 0).alias("documents"),
        F.count_if((F.col("piece") == 0) & (F.col("pieces") > 1)).alias("split_documents"),
        F.coalesce(tokens, F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.try_divide(tokens, windows * capacity), F.lit(0.0)), 4).alias("fill"),
    )


def packing_check(packed: DataFrame, capacity: int) -> DataFrame:
    """(documents, tokens, split_documents, over, broken, whole, full), one row: what a packing must keep.

    over: windows beyond the capacity; broken: pieces that do not begin where the one before ends;
    whole: documents of at most the capacity that are split; full: whether no more windows are used
    than the tokens need, but for one in a hundred and one a group.
    """
    w = packed.groupBy("window").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    windows = w.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("used") > capacity).alias("over"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    first = F.col("piece") == 0
    start = F.when(F.col("pieces") > 1, F.col("piece") * F.lit(capacity)).otherwise(0)
    docs = packed.agg(
        F.count_if(first).alias("documents"), F.count_if(first & (F.col("pieces") > 1)).alias("split_documents"), F.count_if(F.col("token_from") != start).alias("broken"),
        F.count_if((F.col("piece") == 1) & (F.col("piece") == F.col("pieces") - 1) & (F.col("token_to") <= capacity)).alias("whole"),
    )
    need = F.ceil(F.col("tokens") / capacity)
    full = F.col("windows") <= need * 1.01 + 1 + F.col("documents") / (GROUP / 4)
    return docs.join(F.broadcast(windows)).select("documents", "tokens", "split_documents", "over", "broken", "whole", full.alias("full"))
