from datetime import datetime

from quillgraph.operators import orphans as O
from quillgraph.operators import skew as S

T = [datetime(2024, 1, d) for d in range(1, 10)]
REFS = "id int, a string, b string, made timestamp"
RECS = "a string, b string, born timestamp, died timestamp"


def run(spark, refs, recs, **kw):
    df = O.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(recs, RECS), ["a", "b"], at="made", born="born", died="died", **kw)
    return sorted((r.id, r.reason) for r in df.collect())


def test_reasons(spark):
    recs = [("x", "1", T[0], None), ("y", "1", T[0], T[3]), ("z", "1", T[5], None), ("z", "1", T[6], T[7]), ("n", "1", None, None)]
    refs = [(1, "x", "1", T[2]), (2, "y", "1", T[2]), (3, "z", "1", T[2]), (4, "q", "1", T[2]), (5, "z", "1", None), (6, "n", "1", T[2])]
    assert run(spark, refs, recs) == [(2, "deleted"), (3, "late"), (4, "missing")]


def test_null_masks(spark):
    recs = [("x", "1", T[0], None)]
    refs = [(1, "x", None, T[1]), (2, "q", None, T[1]), (3, None, "1", T[1]), (4, None, "2", T[1]), (5, None, None, T[1]), (6, "x", "2", T[1])]
    assert run(spark, refs, recs, match="simple") == [(6, "missing")]
    assert run(spark, refs, recs, match="partial") == [(2, "missing"), (4, "missing"), (6, "missing")]
    assert run(spark, refs, recs, match="full") == [(1, "partial"), (2, "partial"), (3, "partial"), (4, "partial"), (6, "missing")]
    assert run(spark, refs, recs, match="same") == [(1, "missing"), (2, "missing"), (3, "missing"), (4, "missing"), (5, "missing"), (6, "missing")]
    recs += [("x", None, T[3], None), (None, None, T[0], T[1])]
    assert run(spark, refs, recs, match="same") == [(1, "late"), (2, "missing"), (3, "missing"), (4, "missing"), (5, "deleted"), (6, "missing")]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c",), ("c",), ("/c",), ("a/",), ("",)], "path string")
    assert [(r.folder, r.name) for r in O.path_keys(df).collect()] == [("a/b", "c"), (None, "c"), ("", "c"), ("a", ""), (None, "")]


def test_empty_repeats_and_clashing_names(spark):
    refs = spark.createDataFrame([("x", "old", 1, 2), ("x", "old", 1, 2)], "k string, reason string, n int, salt int")
    none = spark.createDataFrame([], "k string, n int")
    out = O.find_orphans(refs, none, ["k"])
    assert out.columns == ["k", "n", "salt", "reason"]
    assert [tuple(r) for r in out.collect()] == [("x", 1, 2, "missing")] * 2
    assert O.find_orphans(refs.limit(0), none, ["k"]).count() == 0


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 100)
    refs = spark.range(1000).selectExpr("cast(id as int) id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, 'gone', cast(id as string))) a", "'1' b", "timestamp'2024-01-02' made")
    recs = spark.createDataFrame([("hot", "1", T[0], T[1]), ("5", "1", T[0], None)], RECS)
    df = O.find_orphans(refs, recs, ["a", "b"], at="made", born="born", died="died")
    got = {r.reason: r["count"] for r in df.groupBy("reason").count().collect()}
    assert got == {"deleted": 334, "missing": 333 + 332}
    by = refs.groupBy(O.F.xxhash64("a").alias("h")).agg(O.F.count("*").alias("n"))
    assert sorted(n for _, n in S.hot_keys(by, 1000)) == [4, 4]  # salts follow the counts


def test_edge_ends(spark):
    rows = [
        (1, "a", "b", " Chunked-From ", T[0]), (2, "q", "b", "RETRIEVED", T[0]), (3, "# s", "t", "edge_type", T[0]), (4, " ", "t", "x", T[0]), (5, "a", None, "x", T[0]), (6, "a", "b", "", T[0]),
    ]
    e = spark.createDataFrame(rows, "seq long, source string, target string, etype string, created_at timestamp")
    assert sorted((r.seq, r.etype, r.side, r.path) for r in O.edge_ends(e).collect()) == [(1, "chunked_from", "source", "a"), (1, "chunked_from", "target", "b"), (2, "retrieved", "target", "b")]
