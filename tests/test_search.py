import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import bm25, fuse, search, vector

DOCS = [("d1/01.txt", "python programming language tutorial"), ("d2/01.txt", "java enterprise framework spring"), ("d3/01.txt", "python data science machine learning"), ("d1/_summary.txt", "python overview guide")]


def chunks(spark, rows=DOCS, kinds=None):
    full = [(p, b, "summary" if "/_" in p else "chunk", False) if kinds is None else (p, b, *kinds[p]) for p, b in rows]
    return spark.createDataFrame(full, "path string, body string, kind string, stale boolean").withColumn("domain", F.split("path", "/")[0])


def scores(df):
    return {r.path: r.score for r in df.collect()}


def test_tokens(spark):
    df = spark.createDataFrame([("State-of the ART! Élan a x2 y_z",), ("",), (None,), (" \n",)], "t string")
    assert [r[0] for r in df.select(X.tokens("t")).collect()] == [["stateof", "the", "art", "élan", "x2", "y_z"], [], None, []]


def test_term_frequency_and_short_words(spark):
    got = {(r.term, r.tf) for r in bm25.postings(chunks(spark, [("a/1.txt", "python python python java a b")])).collect()}
    assert got == {("python", 3), ("java", 1)}


def test_scores_are_the_formula_s(spark):
    got = scores(bm25.search(chunks(spark), bm25.one_query(spark, "python programming")))
    n, avg = 4, sum(len(b) for _, b in DOCS) / 4
    part = lambda df, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got["d1/01.txt"] == pytest.approx(part(3, len(DOCS[0][1])) + part(1, len(DOCS[0][1])), abs=1e-6)
    assert "d2/01.txt" not in got
    scan = scores(bm25.search_scan(chunks(spark), "python programming"))
    assert all(abs(scan[p] - s) < 0.01 for p, s in got.items()) and set(scan) == set(got)


def test_boost_stale_duplicates_domain_and_none(spark):
    kinds = {"a/1.txt": ("chunk", False), "a/_s.txt": ("summary", False), "b/_t.txt": ("summary", True)}
    c = chunks(spark, [(p, "fox fox den") for p in kinds], kinds)
    q = bm25.one_query(spark, "fox")
    s = scores(bm25.search(c, q, boost=1.2, stale_penalty=0.5))
    assert s["a/_s.txt"] == pytest.approx(1.2 * s["a/1.txt"], abs=2e-6) and s["b/_t.txt"] == pytest.approx(0.6 * s["a/1.txt"], abs=2e-6)
    once, twice = scores(bm25.search(c, q)), scores(bm25.search(c, bm25.one_query(spark, "fox fox")))
    assert twice["a/1.txt"] == pytest.approx(2 * once["a/1.txt"], abs=2e-6)
    assert set(scores(bm25.search(c, q, domain="b"))) == {"b/_t.txt"}
    assert scores(bm25.search(c, bm25.one_query(spark, "elephant a"))) == {} == scores(bm25.search(c.limit(0), q)) == scores(bm25.search_scan(c, "x"))


def test_density(spark):
    c = chunks(spark, [("a/1.txt", "search search search search"), ("a/2.txt", "a long sentence in which search comes and search goes again")])
    assert [r.path for r in bm25.keyword_density(c, "search").orderBy("rank").collect()] == ["a/1.txt", "a/2.txt"]
    assert [r.score for r in bm25.keyword_integer(c, "search").orderBy("rank").collect()] == [float(40000 // 27), float(20000 // 59)]


VECS = [("chunk_a", "code", [1, 0, 0]), ("chunk_b", "code", [0, 1, 0]), ("chunk_c", "code", [0, 0, 1]), ("chunk_d", "docs", [1, 1, 0]), ("chunk_e", "docs", [0, 1, 1])]


def vectors(spark):
    return spark.createDataFrame([(p, d, [float(x) for x in v]) for p, d, v in VECS], "path string, domain string, vec array<float>")


def test_knn(spark):
    v, q = vectors(spark), spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, None)], "query_id int, vec array<float>")
    first = vector.knn(v, q, 100).orderBy("rank").collect()
    assert [r.path for r in first] == ["chunk_a", "chunk_d", "chunk_b", "chunk_c", "chunk_e"] and first[0].score == 1.0
    assert {r.path for r in vector.knn(v, q, 5, domain="docs").collect()} == {"chunk_d", "chunk_e"}
    only = spark.createDataFrame([("chunk_b",), ("chunk_c",)], "path string")
    assert {r.path for r in vector.knn(v, q, 5, candidates=only).collect()} == {"chunk_b", "chunk_c"}
    assert vector.knn(v, q, 5, domain="none").count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "query_id int, vec array<float>")
    assert {r.score for r in vector.knn(v, zero, 5).collect()} == {0.0}


def noisy(spark, n=60, dims=16):
    r = np.random.default_rng(1)
    base = r.standard_normal((n // 3, dims))
    x = np.concatenate([base + 0.3 * r.standard_normal(base.shape) for _ in range(3)])
    return x, spark.createDataFrame([(f"p{i:03d}", "d" if i % 2 else None, [float(a) for a in v]) for i, v in enumerate(x)], "path string, domain string, vec array<float>")


def test_relations_exact_and_lsh(spark):
    x, df = noisy(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"p{i:03d}", f"p{j:03d}") for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.8}
    exact = {(r.a, r.b) for r in vector.relate_exact(df, 0.8, block=7).collect()}
    assert exact == want and want
    lsh = {(r.a, r.b) for r in vector.relate_lsh(df, 0.8, dims=16, tables=8, bits=4).collect()}
    assert lsh <= want and len(lsh) > 0.8 * len(want)
    a, b = next(iter(sorted(want)))
    edges = spark.createDataFrame([(b, a, "related_to")], "source string, target string, etype string")
    new = vector.relate(df, edges, 0.8, dims=16).collect()
    assert {(r.source, r.target) for r in new} == want - {(a, b)} and all(r.metadata.startswith("similarity=0.") or r.metadata.startswith("similarity=1.") for r in new)


def test_relations_of_a_large_domain_are_whole(spark):
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(r.standard_normal((1250, 32)))
    x = np.concatenate([base, unit(base + 0.65 * unit(r.standard_normal(base.shape)))])  # cosines around 0.84
    df = spark.createDataFrame([(f"p{i:04d}", "d", [float(a) for a in v]) for i, v in enumerate(x)], "path string, domain string, vec array<double>")
    want = {(f"p{i:04d}", f"p{j:04d}") for i, j in np.argwhere(np.triu(x @ x.T, 1) >= 0.8)}
    none = spark.createDataFrame([], "source string, target string, etype string")
    assert len(want) > 1000 and {(e.source, e.target) for e in vector.relate(df, none, 0.8, dims=32).collect()} == want


def test_the_lsh_query_finds_nine_of_ten(spark, data):
    from quillgraph import queries

    pairs = lambda df: {(r.a, r.b) for r in df.collect()}
    exact, found = pairs(queries.relate_exact(spark, data)), pairs(queries.relate_lsh(spark, data))
    assert exact and found <= exact and len(found) >= 0.9 * len(exact)
    assert vector.tables_for(1.0, 16) == 1 and vector.tables_for(0.8, 16) > 100


def test_embedding_reuses_equal_texts(spark):
    calls = []

    class Engine(vector.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)

    c = spark.createDataFrame([("a", "d", "hello world"), ("b", "d", "hello world"), ("c", "d", "new text"), ("e", "d", " ")], "path string, domain string, body string")
    v = {r.path: r for r in vector.embed(c, Engine(8)).collect()}
    assert set(v) == {"a", "b", "c"} and v["a"].vec == v["b"].vec and v["a"].dims == 8 and not calls
    known = spark.createDataFrame([(v["a"].content_hash, "hash-8", [0.5] * 8)], "content_hash string, model string, vec array<float>")
    again = {r.path: r.vec for r in vector.embed(c, Engine(8), known=known).collect()}
    assert again["a"] == again["b"] == [0.5] * 8 and again["c"] == v["c"].vec


def ranked(spark, paths):
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(paths)], "path string, rank int")


def test_rrf(spark):
    one = {r.path: r.score for r in fuse.rrf([ranked(spark, ["a", "b", "c"])]).collect()}
    assert one == pytest.approx({"a": 1 / 61, "b": 1 / 62, "c": 1 / 63})
    cross = fuse.rrf([ranked(spark, ["a", "b"]), ranked(spark, ["b", "a"])]).orderBy("rank").collect()
    assert [r.path for r in cross] == ["a", "b"] and cross[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert fuse.rrf([ranked(spark, ["a", "a"])]).first().score == pytest.approx(1 / 61 + 1 / 62)
    assert fuse.rrf([ranked(spark, ["a"])], weights=[3.0]).first().score == pytest.approx(3 / 61)
    assert fuse.rrf([ranked(spark, ["a", "b", "c"])], top=2).count() == 2
    with pytest.raises(ValueError):
        fuse.rrf([])


def test_rerank(spark):
    c = spark.createDataFrame([("high_rrf", "q", 1.0, 0.0), ("high_ce", "q", 0.1, 1.0)], "path string, query string, score double, content double")
    got = {r.path: r.score for r in fuse.rerank(c, lambda q, x: x).collect()}
    assert got == pytest.approx({"high_rrf": 0.4, "high_ce": 0.64})
    same = fuse.rerank(c.withColumn("content", F.lit(3.0)), lambda q, x: x).orderBy("rank").collect()
    assert [r.path for r in same] == ["high_rrf", "high_ce"] and same[0].score == pytest.approx(0.4)
    assert [r.path for r in fuse.rerank(c).orderBy("rank").collect()] == ["high_rrf", "high_ce"]


def test_hybrid_and_fallback(spark):
    c = chunks(spark)
    v = spark.createDataFrame([("d3/01.txt", "d3", [1.0, 0.0]), ("d2/01.txt", "d2", [0.9, 0.1])], "path string, domain string, vec array<float>")
    q = spark.createDataFrame([(1, "python", [1.0, 0.0]), (2, "zebra", [1.0, 0.0])], "query_id int, query string, vec array<float>")
    got = search.search(c, v, q, "hybrid", top=3).collect()
    by = {(r.query_id, r.path): r for r in got}
    assert (1, "d2/01.txt") not in by and by[1, "d3/01.txt"].rank == 1
    assert by[2, "d2/01.txt"].rank == 2 and by[2, "d3/01.txt"].explain["bm25"] == 0.0 and by[2, "d3/01.txt"].explain["vector"] == 1.0
    assert set(search.search(c, None, q, "vector").first().explain) == {"bm25"}
    with pytest.raises(ValueError):
        search.search(c, v, q, "semantic")
    r = search.search(c, v, q, "hybrid", top=3, scorer=fuse.overlap_scorer).where("query_id = 1").collect()
    assert set(r[0].explain) == {"bm25", "vector", "rrf", "reranker"}
    full = search.hydrate(spark.createDataFrame([("gone/x/1.txt",), ("d1/01.txt",)], "path string"), c)
    assert {(x.path, x.content, x.domain) for x in full.collect()} == {("gone/x/1.txt", "", "gone"), ("d1/01.txt", DOCS[0][1], "d1")}


def test_hyde_cache(spark):
    q = spark.createDataFrame([(1, "why"), (2, "how")], "query_id int, query string")
    none = spark.createDataFrame([], "query_hash string, passage string")
    first, new = search.hyde(q, none, lambda text: "because" if text == "why" else "")
    assert {r.query: r.expanded for r in first.collect()} == {"why": "because", "how": "how"} and new.count() == 1
    again, fresh = search.hyde(q, new, None)
    assert {r.query: r.expanded for r in again.collect()} == {"why": "because", "how": "how"} and fresh.count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_many_queries_score_as_single_ones(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "DOCUMENTS", 7 * block)
    monkeypatch.setattr(bm25, "QUERIES", block)
    monkeypatch.setattr(bm25.skew, "HOT_ROWS", 10)
    words = ["fox", "owl", "den", "nest", "tree", "river", "stone"]
    rows = [(f"d{i % 4}/{i:02d}.txt", " ".join(["all", *(words[(i * k) % 7] for k in range(1, 2 + i % 5))])) for i in range(60)] + [("x/1.txt", None), ("x/2.txt", " "), ("d0/_s.txt", "all fox fox")]
    c = chunks(spark, rows)
    q = spark.createDataFrame([(i, f"all {words[i % 7]} {words[i % 3]}") for i in range(10)] + [(98, None), (99, "zzz"), (97, "")], "query_id long, query string")
    for kw in ({}, {"domain": "d1"}, {"domain": "d1", "stats_scope": "domain"}, {"boost": 1.5, "stale_penalty": 0.5}):
        one = sorted((r.query_id, r.rank, r.path, r.score) for r in bm25.search(c, q, 5, **kw).collect())
        many = sorted((r.query_id, r.rank, r.path, r.score) for r in bm25.search_many(c, q, 5, **kw).collect())
        assert one == many and one
    stored = bm25.search(None, q, 5, index=bm25.postings(c), stats=bm25.document_stats(c))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, bm25.search(c, q, 5).collect()))
    assert bm25.search_many(c.limit(0), q, 5).count() == 0 and bm25.search_many(c, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        bm25.search(None, q, 5)


def test_knn_in_blocks(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((90, 5)).round(1)
    v = spark.createDataFrame([(f"p{i:02d}", [float(a) for a in x[i]]) for i in range(90)] + [("null", None), ("short", [1.0])], "path string, vec array<float>")
    q = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(25)] + [(90, None), (91, [2.0])], "query_id long, vec array<float>")
    whole = sorted(map(tuple, vector.knn(v, q, 4).collect()))
    assert whole == sorted(map(tuple, vector.knn(v, q, 4, block=7).collect())) and len(whole) == 101
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {i: sorted(((-round(float(u[i] @ u[j]), 6), f"p{j:02d}") for j in range(90)))[:4] for i in range(25)}
    assert all([(-s, p) for q_, p, s, k in sorted(whole, key=lambda t: (t[0], t[3])) if q_ == i] == want[i] for i in range(25))
