"""Vector search, and relations between similar vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import Table

#: Added to a norm before dividing, so that zero vectors score 0 (fixed value).
TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def knn(
    vectors: DataFrame, queries: DataFrame, k: int = 10, *, domain: str | None = None, candidates: DataFrame | None = None, block: int = 2048,
) -> DataFrame:
    """(query_id, path, score, rank): the k vectors of highest cosine for each query, exactly.

    ``vectors``: (path, vec[, domain]); ``queries``: (query_id, vec), a stated set. Each block of
    queries meets each part of the vectors in a task of its own; vectors of other lengths are no matches. ``candidates``: paths
    to which the search is limited, by (path) or by (query_id, path). Ties go to the smaller path.
    """
    if domain is not None:
        vectors = vectors.where(F.col("domain") == domain)
    if candidates is not None and "query_id" not in candidates.columns:
        vectors = vectors.join(candidates.select("path").distinct(), "path", "left_semi")
    if candidates is not None and "query_id" in candidates.columns:
        rows = candidates.select("query_id", "path").distinct().join(vectors.select("path", "vec"), "path").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
        scored = rows.select("query_id", "path", F.round(cosine(F.col("vec"), F.col("q")), 6).alias("score"))
        return _rank(scored, k)
    held = queries.select("query_id", "vec").where(F.col("vec").isNotNull())
    id_type = held.schema["query_id"].dataType.simpleString()
    asked = Table(held, "asked").df  # the stated query set
    blocks = max(1, math.ceil(asked.count() / block))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(F.lit(4), c), F.lit(n)).cast("int")
    single = F.col("vec").cast("array<float>").alias("vec")
    q = asked.select(every(parts).alias("part"), of("query_id", blocks).alias("block"), F.lit(0).alias("side"), "query_id", F.lit(None).cast("string").alias("path"), single)
    v = vectors.where(F.col("vec").isNotNull()).select(of("path", parts).alias("part"), every(blocks).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(id_type).alias("query_id"), "path", single)
    key = (F.col("part") * blocks + F.col("block")).alias("key")
    dealt = q.unionByName(v).select(key, "side", "query_id", "path", "vec").repartitionById(parts * blocks, F.col("key")).sortWithinPartitions("side")
    local = dealt.mapInPandas(_local_top(k), f"query_id {id_type}, path string, score double")
    return _rank(local.withColumn("score", F.round("score", 6)), k)


def _local_top(k: int):
    """Keeps a part's k best of each query, and all that tie with the last after rounding; queries come first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, list] = {}
        rows: dict[int, list] = {}
        units: dict[int, np.ndarray] = {}
        best: pd.DataFrame | None = None
        for b in batches:
            for side, part in b.groupby("side"):
                width = part["vec"].map(len)
                for dims, same in part.groupby(width):
                    x = np.stack(same["vec"].to_numpy()).astype(np.float64) if dims else np.zeros((len(same), 0))
                    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)
                    if side == 0:
                        ids.setdefault(dims, []).extend(same["query_id"])
                        rows.setdefault(dims, []).append(x)
                        continue
                    if dims not in rows:
                        continue
                    if dims not in units:
                        units[dims] = np.concatenate(rows[dims])
                    q, paths = np.array(ids[dims], object), same["path"].to_numpy()
                    for at in range(0, len(x), 1024):
                        s = units[dims] @ x[at : at + 1024].T
                        keep = min(k, s.shape[1])
                        floor = np.partition(s, -keep, axis=1)[:, -keep] - 1e-6
                        i, j = np.nonzero(s >= floor[:, None])
                        now = pd.DataFrame({"query_id": q[i], "path": paths[at + j], "score": s[i, j]})
                        best = now if best is None else pd.concat([best, now])
                        if len(best) > 8 * k * len(q):
                            best = _cut(best, k)
        if best is not None:
            yield _cut(best, k)

    return run


def _cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.assign(r=rows["score"].round(6)).sort_values(["query_id", "r", "path"], ascending=[True, False, True])
    return rows.groupby("query_id", sort=False).head(k).drop(columns="r")


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Vectors of a block of the exact pair search.
BLOCK = 1000


def _pairs_in(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    x = np.stack([np.asarray(v, np.float64) for v in group["vec"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + TINY
    own, lo, hi = group["own"].to_numpy(), group["lo"].iloc[0], group["hi"].iloc[0]
    a = np.nonzero(own == lo)[0]
    b = np.nonzero(own == hi)[0]
    s = x[a] @ x[b].T
    if lo == hi:
        s[np.tril_indices(len(a))] = -9
    i, j = np.nonzero(s >= threshold)
    paths = group["path"].to_numpy()
    p, q = paths[a[i]], paths[b[j]]
    flip = p > q
    return pd.DataFrame({"a": np.where(flip, q, p), "b": np.where(flip, p, q), "similarity": s[i, j]}).assign(domain=group["domain"].iloc[0])


def _blocked(vectors: DataFrame, keys: list[str], threshold: float, block: int) -> DataFrame:
    """(domain, a, b, similarity) of the pairs that agree on the keys, one group for each pair of blocks of a key."""
    counts = vectors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = vectors.join(counts, keys).withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = spread.select(*keys, "path", "vec", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    run = [*keys, "lo", "hi"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # many groups are tiny, so a task takes them one after another instead of one call each
        held: list[pd.DataFrame] = []
        now: tuple | None = None
        for b in batches:
            found = []
            for key, rows in b.groupby(run, sort=False):
                if key != now and held:
                    found.append(_pairs_in(pd.concat(held) if len(held) > 1 else held[0], threshold))
                    held = []
                now = key
                held.append(rows)
            if found:
                yield pd.concat(found)
        if held:
            yield _pairs_in(pd.concat(held), threshold)

    sorted_ = placed.repartition(*run).sortWithinPartitions(*run)
    return sorted_.mapInPandas(compare, "a string, b string, similarity double, domain string").select("domain", "a", "b", "similarity")


def relate_exact(vectors: DataFrame, threshold: float = 0.8, *, block: int = BLOCK) -> DataFrame:
    """(domain, a, b, similarity), a < b: all pairs of a domain at or above the threshold, compared in blocks.

    ``vectors``: (path, domain, vec) of one length; a null domain counts as ''. A domain of n vectors
    makes pairs of its n / block blocks, each its own group, so no task holds more than two blocks.
    """
    return _blocked(vectors.select("path", F.coalesce("domain", F.lit("")).alias("domain"), "vec"), ["domain"], threshold, block)


def hyperplanes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """(tables, dims, bits) normal vectors in single precision, all from one seeded generator."""
    r = np.random.RandomState(seed)
    return np.stack([r.randn(dims, bits).astype(np.float32) for _ in range(tables)])


def lsh_buckets(vectors: DataFrame, planes: np.ndarray) -> DataFrame:
    """(domain, path, vec, slot, bucket): the bucket of each vector in every table of hyperplanes."""
    tables, dims, bits = planes.shape
    shared = vectors.sparkSession.sparkContext.broadcast(planes)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def buckets(vecs: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, np.float32) for v in vecs]) if len(vecs) else np.zeros((0, dims), np.float32)
        weights = 1 << np.arange(bits, dtype=np.int64)
        found = np.stack([((x @ p) > 0) @ weights for p in shared.value], axis=1)
        return pd.Series(list(found))

    of = vectors.where(F.size("vec") == dims).withColumn("_b", buckets("vec"))
    return of.select("domain", "path", "vec", F.posexplode("_b").alias("slot", "bucket"))


#: Share of the pairs at the threshold itself that are to share a bucket; of closer ones more do.
RECALL = 0.95


def tables_for(threshold: float, bits: int, recall: float = RECALL) -> int:
    """Tables of hyperplanes in which a pair at the threshold shares a bucket with the probability ``recall``."""
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if meet == 0:
        raise ValueError("opposite vectors share no bucket; use relate_exact")
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def relate_lsh(vectors: DataFrame, threshold: float = 0.8, *, dims: int, tables: int | None = None, bits: int = 16, seed: int = 42) -> DataFrame:
    """(domain, a, b, similarity), a < b: the pairs at or above the threshold that share a bucket; cosines are exact.

    ``tables``: by default as many as threshold and bits need for the share RECALL of the pairs.
    Buckets larger than a block are compared block by block, so that none is too large for a task.
    """
    named = vectors.select("path", F.coalesce("domain", F.lit("")).alias("domain"), "vec")
    placed = lsh_buckets(named, hyperplanes(dims, tables or tables_for(threshold, bits), bits, seed))
    return _blocked(placed, ["domain", "slot", "bucket"], threshold, BLOCK).groupBy("domain", "a", "b").agg(F.max("similarity").alias("similarity"))


#: Vectors of a block where all pairs of large domains are compared.
LARGE_BLOCK = 2048


def relate(vectors: DataFrame, edges: DataFrame, threshold: float = 0.8, *, dims: int) -> DataFrame:
    """(source, target, etype, metadata): new ``related_to`` edges; pairs related in either direction are left out.

    All pairs of a domain are compared, however many vectors of ``dims`` numbers it has.
    """
    pairs = relate_exact(vectors.where(F.size("vec") == dims), threshold, block=LARGE_BLOCK)
    known = edges.where(F.col("etype") == "related_to").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    new = pairs.join(known, ["a", "b"], "left_anti")
    return new.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("related_to").alias("etype"), F.format_string("similarity=%.4f", "similarity").alias("metadata"))


class Embedder:
    """An embedding engine: texts to vectors. Subclasses load their model once per worker."""

    dims = 0
    name = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class HashEmbedder(Embedder):
    """A deterministic engine without a model: signed hashes of words, unit length."""

    def __init__(self, dims: int = 64):
        self.dims, self.name = dims, f"hash-{dims}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


def embed(chunks: DataFrame, engine: Embedder, *, text: str = "body", known: DataFrame | None = None) -> DataFrame:
    """(path, domain, vec, dims, model, content_hash) of chunks that are not blank.

    ``known``: stored vectors (content_hash, model, vec); a text whose hash has one is not embedded again.
    """
    from ..functions import text as X

    rows = chunks.where(X.has_body(text)).select("path", "domain", F.col(text).alias("_text"), X.content_hash(text).alias("content_hash"))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([np.asarray(v, np.float32) for v in engine.embed(list(texts))])

    model = F.lit(engine.name).alias("model")
    texts = rows.groupBy("content_hash").agg(F.first("_text").alias("_text"))
    if known is not None:
        have = known.where(F.col("model") == engine.name).groupBy("content_hash").agg(F.first("vec").alias("vec"))
        fresh = texts.join(have, "content_hash", "left_anti").select("content_hash", run("_text").alias("vec"))
        vecs = have.unionByName(fresh)
    else:
        vecs = texts.select("content_hash", run("_text").alias("vec"))
    return rows.drop("_text").join(vecs, "content_hash").select("path", "domain", "vec", F.size("vec").alias("dims"), model, "content_hash")
