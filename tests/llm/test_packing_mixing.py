import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import mixing as M
from quillgraph.llm import packing as P
from quillgraph.llm.sizes import byt5_size


def test_size(spark):
    df = spark.createDataFrame([("abc",), ("é",), ("",), ("  \n",), (None,)], "text string")
    assert [r[0] for r in df.select(byt5_size(F.col("text"))).collect()] == [4, 3, 0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 60))
def test_pack(sizes, capacity):
    s = np.array(sizes, np.int64)
    w = P.pack(s, capacity)
    fill = np.bincount(w, s) if len(s) else np.zeros(0)
    assert len(w) == len(s) and (fill <= capacity).all()
    assert not len(s) or not s.sum() or (fill > 0).all()
    assert sum(f <= capacity / 2 for f in fill if f) <= 1  # two such windows would be one


def test_local_search_closes_gaps():
    s = np.array([6, 6, 5, 5, 4, 4, 7, 3], np.int64)
    assert P.pack(s, 10).max() + 1 == 4
    r = np.random.default_rng(1).integers(1, 1200, 3000)
    assert P.pack(r, 2048).max() + 1 <= -(-r.sum() // 2048) + 2


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    big = 1 << 60
    rows = [(big + i, "x" * (i % 90), 1, "s") for i in range(200)] + [(7, "é" * 500, 1, "s"), (8, None, 1, "s"), (9, " ", 1, "s"), (None, "abc", 1, "s"), (10, "r", 1, "s"), (10, "r", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, window int, piece string")
    p = P.pack_documents(df, 100, byt5_size(F.col("text"))).toPandas()
    assert len(p) == 206 + 10 and (p["token_to"] - p["token_from"]).groupby(p["window"]).sum().max() <= 100
    long = p[p["doc_id"] == 7].sort_values("piece")
    assert len(long) == 11 and (long["pieces"] == 11).all() and long["token_to"].iloc[-1] == 1001
    assert (long["token_from"].iloc[1:].values == long["token_to"].iloc[:-1].values).all()
    assert P.pack_documents(df.limit(0), 100, byt5_size(F.col("text"))).count() == 0
    r = P.fill_report(P.pack_documents(df.limit(0), 100, byt5_size(F.col("text"))), 100).first()
    assert r.windows == 0 and r.tokens == 0


W = "source string, weight double, max_repeats int, own string"


def test_plan(spark):
    docs = spark.createDataFrame([(1, "x" * 9, "A "), (2, "x" * 9, "a"), (3, "x" * 19, "b"), (4, "x" * 99, None), (5, "x" * 99, "zz"), (6, None, "a")], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1.0, None, ""), ("B", 3.0, 2, ""), ("c", 1.0, 5, ""), ("d", None, 1, ""), ("e", 0.0, 1, ""), ("f", float("nan"), 1, ""), (None, 9.0, 1, "")], W)
    p = {r.source: r for r in M.plan_mixture(docs, w, byt5_size(F.col("text"))).collect()}
    assert set(p) == {"a", "b", "c"} and (p["a"].own, p["b"].own, p["c"].own) == (20, 20, 0)
    assert (p["a"].budget, p["b"].budget, p["c"].budget) == (8.0, 24.0, 8.0)
    assert (p["a"].feasible, p["b"].feasible, p["c"].feasible) == (True, True, False)


def test_mix(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('ab', cast(1 + id % 40 as int)) text", "if(id % 3 = 0, 'hot', if(id % 3 = 1, 'few', 'rest')) source", "1 tokens")
    docs = docs.where("source <> 'few' or doc_id < 300")
    w = spark.createDataFrame([("hot", 1.0, 1, ""), ("few", 4.0, 3, ""), ("rest", 5.0, 2, "")], W)
    size = byt5_size(F.col("text"))
    m, plan = M.mix(docs, w, size), M.plan_mixture(docs, w, size)
    got = m.toPandas()
    p = {r.source: r for r in plan.collect()}
    assert got["doc_id"].is_unique
    used = (got["tokens"] * got["copies"]).groupby(got["source"]).sum()
    assert used["few"] == 3 * p["few"].own and not p["few"].feasible
    for s in ("hot", "rest"):
        assert p[s].budget - 85 < used[s] <= p[s].budget
    assert set(got[got["source"] == "rest"]["copies"]) == {1, 2} and len(got[got["source"] == "rest"]) == docs.where("source = 'rest'").count()
    again = M.mix(docs.repartition(7), w, size).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    shares = {r.source: r.reached for r in M.mixture_report(plan, m).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9
    assert M.mix(docs.limit(0), w, size).count() == 0 and M.mix(docs, w.limit(0), size).count() == 0


def test_quality_decides_who_comes_first(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "if(id % 2 = 0, 'abcdefghij', '1234567x90') text", "'s' source").unionByName(spark.range(2000, 4000).selectExpr("id doc_id", "'abcdefghij' text", "'t' source"))
    w = spark.createDataFrame([("s", 1.0, 1, ""), ("t", 3.0, 2, "")], W)
    got = M.mix(docs, w, byt5_size(F.col("text"))).where("source = 's'").toPandas()
    assert len(got) == 1000 and (got["doc_id"] % 2 == 0).mean() > 0.8
