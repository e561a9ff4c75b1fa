"""The most similar vectors of every vector.

Without a threshold, every vector is compared with all others, by matrix products of 16-bit vectors
in parts: the ten nearest of vectors without clusters are so distant that neither cells nor the
codes' error bounds would leave out much without losing some. With a threshold, cells and codes do.

Cells: a sample of the vectors serves as cell centres, some 3 sqrt(n) of them at every n; every vector
goes to the cells whose centres are nearest, to so many that of pairs at the very threshold the share
MEET has a cell in common, as measured on the sample. Beyond FLAT centres these are grouped around
some of their own, and a vector looks only into the nearest groups; what that misses is in what is
measured. Cells that the sample shows to be large are split into blocks, and pairs of blocks become
groups of their own, so that no group is unbounded.

Codes: in a cell, vectors are compared by randomly rotated one-bit codes. A code is the signs of the
rotated unit vector; with the scalar <code, vector> it gives an unbiased estimate of the inner
product with any query, taken from the packed bits and a query of 4-bit numbers by and + popcount.
The estimate's error bound tells which vectors could reach the threshold; only those are reranked, by 8-bit vectors in the cell and, for what is returned, by exact cosines.

Exact copies are compared once: one of them stands for all, and the others take over its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.vector import knn
from ..scratch import Table

#: Least cells of each vector; most centres that are searched without groups; rows of a block.
PROBES, FLAT, BLOCK = 6, 4096, 4096
#: Share of the pairs at the threshold itself that are to share a cell.
MEET = 0.97
#: Parts of the search without a threshold, and the least and the most vectors of one.
PARTS, PART, MOST = 12, 8192, 65536
#: Cosines of 16-bit vectors that differ by less are taken again from the vectors themselves.
TIE = 4e-5
#: Width of the error bound in standard deviations; slack for 8-bit reranking.
EPSILON, SLACK = 2.4, 0.02


def usable(vec: Column, dims: int) -> Column:
    """Of ``dims`` numbers, none of them NaN or infinite, not all zero."""
    most, least = F.array_max(vec), F.array_min(vec)  # NaN is the largest number to Spark
    inf = float("inf")
    return F.coalesce((F.size(vec) == dims) & ~F.isnan(most) & (most < inf) & (least > -inf) & ~((most == 0) & (least == 0)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cell_count(n: int) -> int:
    """Cells for n vectors; one, and so an exact comparison, for few."""
    return 1 if n <= BLOCK // 2 else 1 << round(math.log2(3 * math.sqrt(n)))


class Centres:
    """Cell centres, grouped around some of them where they are many."""

    def __init__(self, centres: np.ndarray, flat: int | None = None):
        self.centres, self.groups = centres, None
        if len(centres) > (FLAT if flat is None else flat):
            heads = centres[: math.ceil(math.sqrt(len(centres)))]
            of = np.concatenate([(centres[i : i + 4096] @ heads.T).argmax(1) for i in range(0, len(centres), 4096)])
            self.heads, self.groups = heads, [np.nonzero(of == g)[0] for g in range(len(heads))]
            self.looked = max(16, math.ceil(len(heads) / 8))  # groups that a vector looks into

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells of each vector, nearest first; -1 where the groups hold fewer."""
        if self.groups is None:
            s = x @ self.centres.T
            near = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
            return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        looked = min(self.looked, len(self.heads))
        into = np.argpartition(-(x @ self.heads.T), looked - 1, axis=1)[:, :looked]
        best_s, best = np.full((len(x), probes), -9, np.float32), np.full((len(x), probes), -1, np.int64)
        for g in np.unique(into).tolist():
            if not len(self.groups[g]):
                continue
            rows = np.nonzero((into == g).any(1))[0]
            both_s = np.concatenate([best_s[rows], (x[rows] @ self.centres[self.groups[g]].T).astype(np.float32)], 1)
            both = np.concatenate([best[rows], np.broadcast_to(self.groups[g], (len(rows), len(self.groups[g])))], 1)
            top = np.argsort(-both_s, axis=1, kind="stable")[:, :probes]
            best_s[rows], best[rows] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both, top, 1)
        return best


def probes_for(centres: np.ndarray | Centres, units: np.ndarray, floor: float, seed: int = 0) -> int:
    """Cells of each vector with which the share MEET of pairs at a cosine of ``floor`` share one.

    Measured on at most 1,024 of the units, each with a partner in a random direction.
    """
    of = centres if isinstance(centres, Centres) else Centres(centres)
    count = len(of.centres)
    r = np.random.default_rng(seed)
    floor = max(-1.0, min(1.0, floor))
    x = units[:1024].astype(np.float64)
    if not len(x):
        return min(count, PROBES)
    off = r.standard_normal(x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = floor * x + math.sqrt(1 - floor**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    most = min(count, 64)
    while True:
        a, b = of.nearest(x.astype(np.float32), most), of.nearest(y.astype(np.float32), most)
        meet = np.full(len(x), most)  # the first place by which both have a cell in common
        for i in range(most):
            same = (a == b[:, i : i + 1]) & (a >= 0)
            meet = np.minimum(meet, np.where(same.any(1), np.maximum(same.argmax(1), i), most))
        place = int(np.sort(meet)[math.ceil(MEET * len(meet)) - 1])
        if place < most or most == count:
            return min(count, max(PROBES, place + 1))
        most = min(count, 2 * most)


def _rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(vecs: pd.Series, dims: int) -> np.ndarray:
    x = np.concatenate(vecs.to_numpy()).astype(np.float64).reshape(len(vecs), dims)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    wide = -(-bits.shape[1] // 64) * 64
    return np.packbits(np.pad(bits, ((0, 0), (0, wide - bits.shape[1]))), axis=1).view(np.uint64)


def encode(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-bit codes of unit vectors as words, and <code, vector>."""
    y = x @ rotation
    return _words((y > 0).astype(np.uint8)), np.abs(y).sum(1) / np.float32(math.sqrt(x.shape[1]))


class Query:
    """Unit vectors ready to be compared with codes."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray):
        y = x @ rotation
        self.dims = x.shape[1]
        self.low = y.min(1)
        self.step = np.maximum(y.max(1) - self.low, 1e-12) / 15
        u = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words((u >> j) & 1) for j in range(4)]
        self.total = y.sum(1)

    def estimate(self, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates of the inner products, error bounds of the codes) for all queries and codes."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        dot = np.zeros((len(self.low), len(codes)), np.uint16)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                dot += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint16) << j
        est = self.step[:, None] * dot + self.low[:, None] * ones[None, :]
        est = (2 * est - self.total[:, None]) / (np.float32(math.sqrt(self.dims)) * scalars[None, :])
        err = EPSILON * np.sqrt(np.maximum(0, 1 - scalars**2) / (scalars**2 * max(1, self.dims - 1)))
        return est, err


def _compare(x: np.ndarray, block: np.ndarray, rotation: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine) of the k best others at or above the floor of each row among the rows of its cell.

    ``block``: where it has two values, only pairs across them count.
    """
    codes, scalars = encode(x, rotation)
    across = block.min() != block.max()
    cols = np.nonzero(block == block.max())[0] if across else np.arange(len(x))
    rows = np.nonzero(block == block.min())[0] if across else cols
    a, b, s = [], [], []
    for lo in range(0, len(rows), 256):
        r = rows[lo : lo + 256]
        est, err = Query(x[r], rotation).estimate(codes[cols], scalars[cols])
        if not across:
            est[cols[None, :] <= r[:, None]] = -9  # each pair once, it is kept for both
        i, j = np.nonzero(est + err >= floor - SLACK)
        if not len(i):
            continue
        i, j = r[i], cols[j]
        dots = np.concatenate([np.einsum("ij,ij->i", x[i[q : q + 65536]], x[j[q : q + 65536]]) for q in range(0, len(i), 65536)])
        near = dots >= floor - SLACK
        i, j, dots = i[near], j[near], dots[near]
        a += [i, j]
        b += [j, i]
        s += [dots, dots]
    if not a:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    order, best = _first_of(a, b, s, k + 2)  # two more than asked, as 8-bit cosines may swap places
    return a[order][best], b[order][best], s[order][best]


def _first_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(an order by a, falling s and b, which of the ordered entries are among the k first of their a)."""
    order = np.lexsort((b, -s, a))
    a = a[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return order, place < k


class Nearest:
    """The ``keep`` nearest others of each row of ``x`` among all unit vectors that are shown to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int):
        self.ids, self.x, self.keep = ids, x, keep
        self.least = np.full(len(x), -2, np.float32)  # the cosine of the last one kept, from which others count
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        self.new = 0

    def show(self, ids: np.ndarray, y: np.ndarray) -> None:
        for lo in range(0, len(y), 2048):
            part, names = y[lo : lo + 2048].T, ids[lo : lo + 2048]
            for at in range(0, len(self.x), 512):
                s = self.x[at : at + 512] @ part
                least = self.least[at : at + 512]
                if s.shape[1] > self.keep + 1 and least.min() <= -2:  # one more, for the row itself
                    least = np.maximum(least, np.partition(s, -self.keep - 1, axis=1)[:, -self.keep - 1])
                i, j = np.nonzero(s >= least[:, None])
                other = self.ids[at + i] != names[j]
                i, j = i[other], j[other]
                self.held.append((at + i, names[j], s[i, j]))
                self.new += len(i)
            if self.new > len(self.x) * self.keep // 2:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id of the other, cosine) so far."""
        row, other, s = (np.concatenate(v) for v in zip(*self.held))
        order, best = _first_of(row, other, s, self.keep)
        row, other, s = row[order][best], other[order][best], s[order][best]
        full = np.bincount(row, minlength=len(self.x)) == self.keep
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        self.least[full] = s[last & full[row]]
        self.held, self.new = [(row, other, s)], 0
        return row, other, s


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(one row for each distinct vector, (id, rep) of all rows that have a copy, None if there are none)."""
    keyed = rows.select("id", F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    many = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    copies = Table(keyed.join(many.drop("_n"), ["h", "g"]).select("id", "rep"), "copies").df
    if copies.isEmpty():
        return rows, None
    return rows.join(copies.where(F.col("id") != F.col("rep")).select("id"), "id", "left_anti"), copies


def _cells(reps: DataFrame, dims: int, k: int, floor: float, seed: int) -> DataFrame:
    """(a, b, sim): for each vector candidates for its nearest others at or above the floor; sim from 8-bit vectors."""
    spark = reps.sparkSession
    n = reps.select("id").count()
    cells = cell_count(n)
    rotation = _rotation(dims, seed)
    blocks = np.ones(cells, np.int64)
    if cells > 1:
        # a sample by hash of some 2 cells = 6 sqrt(n) rows, for the centres and for what is measured with them
        drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40))
        sample = reps.withColumn("drawn", drawn).where(F.col("drawn") < int(min(1.0, 2.2 * cells / n) * (1 << 40))).toPandas().sort_values(["drawn", "id"])
        units = _unit(sample["vec"], dims)
        cells = min(cells, max(1, len(units) // 2))
        centres, others = Centres(units[:cells]), units[cells : 3 * cells]
        probes = probes_for(centres, others, floor, seed)
        near = centres.nearest(others, probes).ravel()
        share = np.bincount(near[near >= 0], minlength=cells) / max(1, len(others))
        blocks = np.maximum(1, np.ceil(share * n / BLOCK).astype(np.int64))
    else:
        centres, probes = Centres(np.zeros((1, dims), np.float32)), 1
        blocks[0] = max(1, math.ceil(n / BLOCK))
    shared = spark.sparkContext.broadcast((centres, rotation, blocks))
    width = dims + 4

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _, blocks = shared.value
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                x = _unit(part["vec"], dims)
                ids = part["id"].to_numpy()
                fine = np.isfinite(x).all(1)
                x, ids = x[fine], ids[fine]
                if not len(ids):
                    continue
                near = centres.nearest(x, probes) if cells > 1 else np.zeros((len(x), 1), np.int64)
                scale = np.abs(x).max(1) / 127
                raw = np.empty((len(x), width), np.uint8)
                raw[:, :4] = scale.astype(np.float32)[:, None].view(np.uint8)
                raw[:, 4:] = np.rint(x / scale[:, None]).astype(np.int8).view(np.uint8)
                row, cell = np.repeat(np.arange(len(x)), probes), near.ravel()
                row, cell = row[cell >= 0], cell[cell >= 0]
                count = blocks[cell]
                own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count
                row, cell, own, count = (np.repeat(v, count) for v in (row, cell, own, count))
                first = np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])] if len(row) else np.zeros(0, bool)
                other = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                code = [raw[i].tobytes() for i in range(len(x))]
                yield pd.DataFrame(
                    {
                        "cell": cell.astype("int32"), "lo": np.minimum(own, other).astype("int32"), "hi": np.maximum(own, other).astype("int32"),
                        "own": own.astype("int32"), "id": ids[row], "code": [code[i] for i in row],
                    }
                )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        _, rotation, _ = shared.value
        raw = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), width)
        x = raw[:, 4:].view(np.int8) * raw[:, :4].copy().view(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, own = group["id"].to_numpy(), group["own"].to_numpy()
        if group["lo"].iloc[0] != group["hi"].iloc[0] and own.min() == own.max():
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": np.zeros(0, np.float32)})
        a, b, s = _compare(x, own, rotation, k, floor)
        return pd.DataFrame({"a": ids[a], "b": ids[b], "sim": s.astype(np.float32)})

    placed = reps.select("id", "vec").mapInPandas(assign, "cell int, lo int, hi int, own int, id long, code binary")
    return placed.groupBy("cell", "lo", "hi").applyInPandas(search, "a long, b long, sim float")


def _all(reps: DataFrame, dims: int, k: int) -> DataFrame:
    """(a, b, sim): for each vector the k + 2 nearest of all others; sim from 16-bit vectors.

    A task holds the vectors of one part and all vectors pass by, some thousand at a time.
    """
    n = reps.select("id").count()
    parts = max(1, math.ceil(n / min(max(math.ceil(n / PARTS), PART), MOST)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, ids = _unit(b["vec"], dims), b["id"].to_numpy()
            fine = np.isfinite(x).all(1)
            x, ids = x[fine], ids[fine]
            raw = np.rint(x * (32767 / np.abs(x).max(1, keepdims=True))).astype(np.int16)
            own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            there = np.unique(own)
            yield pd.DataFrame({"own": there.astype("int32"), "ids": [ids[own == o].tobytes() for o in there], "codes": [raw[own == o].tobytes() for o in there]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Nearest | None = None
        mine, held, rows = [], [], 0

        def read(packed: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(c for _, c in packed), np.int16).reshape(-1, dims).astype(np.float32)
            return np.frombuffer(b"".join(i for i, _ in packed), np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)

        for b in batches:
            for part, own, ids, codes in zip(b["part"], b["own"], b["ids"], b["codes"]):
                if part == own:  # these come first
                    mine.append((ids, codes))
                    continue
                if not mine:
                    continue
                if found is None:
                    found = Nearest(*read(mine), k + 2)
                    found.show(found.ids, found.x)
                held.append((ids, codes))
                rows += len(ids) // 8
                if rows >= 4096:
                    found.show(*read(held))
                    held, rows = [], 0
        if found is None and mine:
            found = Nearest(*read(mine), k + 2)
            found.show(found.ids, found.x)
        if found is None:
            return
        if held:
            found.show(*read(held))
        a, b, s = found.best()
        yield pd.DataFrame({"a": found.ids[a], "b": b, "sim": np.minimum(s, 1)})

    packed = reps.select("id", "vec").mapInPandas(pack, "own int, ids binary, codes binary")
    to = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = to.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("part") != F.col("own"))
    return dealt.mapInPandas(search, "a long, b long, sim float")


def _best(pairs: DataFrame, of: str, k: int, *order: Column) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, dims: int, k: int = 10, *, min_cosine: float | None = None, exact: bool = True, id: str = "vec_id", vec: str = "vec", seed: int = 11) -> DataFrame:
    """(vec_id, neighbor, cosine, rank): up to ``k`` other vectors of highest cosine for every usable vector.

    Unusable vectors (null, another length, NaN, infinite, all zero) neither have nor are neighbours.
    Every vector is compared with all others. ``min_cosine``: only neighbours at or above it, which are
    searched in cells: of the pairs at or above it at least 95% are to be found. Cosines are
    exact, or with ``exact`` False those of 16-bit vectors but where two of a vector's are within TIE (with
    ``min_cosine`` those of 8-bit vectors, within 0.01), which saves two joins with the vectors; ties (to 7 digits) go to the smaller id. Exact copies are each other's neighbours at
    cosine 1, the smallest ids first. ``id`` must be unique; rows without one are left out; an empty table gives no rows; extra
    columns are not read.
    """
    rows = vectors.where(usable(F.col(vec), dims) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))
    reps, copies = _collapse(rows)
    if min_cosine is None:
        found = _all(reps, dims, k)
    else:
        found = _cells(reps, dims, k, min_cosine, seed).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    found = Table(found.select("a", "b", "sim"), "candidates").df
    kept = None
    if not exact:
        w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        step = lambda other: F.coalesce(F.abs(F.col("sim") - other), F.lit(9.0)) < TIE
        close = step(F.lag("sim").over(w)) | step(F.lead("sim").over(w)) if min_cosine is None else F.lit(False)
        told = found.withColumn("close", close)
        kept = told.where(~F.col("close")).select("a", "b", F.col("sim").cast("double").alias("cosine"))
        found = told.where("close").drop("close")
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    there = rows.join(ends, "id", "left_semi")
    both = found.join(there.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(there.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    rated = both.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine")) if exact or min_cosine is None else kept
    if not exact and min_cosine is None:
        rated = rated.unionByName(kept)
    if min_cosine is not None:
        rated = rated.where(F.col("cosine") >= min_cosine)
    order = F.desc(F.round("cosine", 7)), F.col("b")  # vectors of one direction tie
    if copies is None:
        return _best(rated, "a", k, *order).select(F.col("a").alias(id), F.col("b").alias("neighbor"), "cosine", "rank")
    # a vector with copies takes over the neighbours of the one that stood for all; at most k + 1 of a group can be anybody's nearest
    heads = _best(copies.withColumnRenamed("id", "b"), "rep", k + 1, F.col("b")).select("rep", "b")
    of = rated.unionByName(copies.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine")).distinct())
    spread = of.withColumnRenamed("b", "rep").join(heads, "rep", "left").select("a", F.coalesce("b", "rep").alias("b"), "cosine")
    lists = _best(spread, "a", k + 1, *order).select("a", "b", "cosine")
    each = lists.join(copies.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("id", "a").alias("a"), "b", "cosine").where(F.col("a") != F.col("b"))
    return _best(each, "a", k, *order).select(F.col("a").alias(id), F.col("b").alias("neighbor"), "cosine", "rank")


def similar_pairs(vectors: DataFrame, dims: int, threshold: float, k: int = 10, **kw) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: the pairs at or above the threshold that ``nearest`` finds."""
    n = nearest(vectors, dims, k, min_cosine=threshold, **kw)
    a, b = n.columns[:2]
    return n.select(F.least(a, b).alias("vec_id_a"), F.greatest(a, b).alias("vec_id_b")).distinct()


def recall(found: DataFrame, vectors: DataFrame, dims: int, k: int = 10, *, every: int = 50, min_cosine: float | None = None, id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(queries, wanted, hits), one row: of the k nearest of the vectors whose id is divisible by ``every``, by brute force, how many ``found`` has.

    ``found``: (id, neighbor). With ``min_cosine`` only neighbours at or above it are wanted. Neighbours
    that tie with the last one wanted count as well as it.
    """
    rows = vectors.where(usable(F.col(vec), dims) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))
    asked = rows.where(F.col("id") % every == 0)
    true = knn(rows.select(F.col("id").cast("string").alias("path"), "vec"), asked.select(F.col("id").alias("query_id"), "vec"), k + 1).where(F.col("path") != F.col("query_id").cast("string"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    true = true.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    if min_cosine is not None:
        true = true.where(F.col("score") >= min_cosine)
    least = true.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.min("score").alias("least"))
    got = found.select(F.col(id).alias("query_id"), F.col("neighbor")).join(least, "query_id").join(rows.select(F.col("id").alias("query_id"), F.col("vec").alias("a")), "query_id")
    got = got.join(rows.select(F.col("id").alias("neighbor"), F.col("vec").alias("b")), "neighbor").where(cosine(F.col("a"), F.col("b")) >= F.col("least") - 2e-6)
    per = least.join(got.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")), "query_id", "left").select("wanted", F.least("wanted", F.coalesce("got", F.lit(0))).alias("hits"))
    n = asked.agg(F.count(F.lit(1)).alias("queries"))
    return n.join(F.broadcast(per.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))))  # one row each
