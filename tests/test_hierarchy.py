import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillgraph.operators import hierarchy as H


def brute(par):
    out = {}
    for n in par:
        way, x = [n], n
        while x in par and par[x] not in way:
            x = par[x]
            way.append(x)
        out[n] = (min(way[way.index(par[x]) :]), -1) if x in par else (x, len(way) - 1)
    return out


def check(spark, par):
    tree = H.hierarchy(spark.createDataFrame(list(par.items()), "node string, parent string")).toPandas()
    assert {r.node: (r.root, r.depth) for r in tree.itertuples() if r.parent is not None} == brute(par)
    a = tree[~tree["cyclic"].astype(bool)]
    assert sorted(a["pre"]) == list(range(len(a)))
    pre = {r.node: (r.pre, r.pre + r.size) for r in a.itertuples()}
    for n, p in par.items():
        if n in pre:
            assert pre[p][0] < pre[n][0] and pre[n][1] <= pre[p][1]
    sizes = {r.node: r.size for r in a.itertuples()}
    for n, s in sizes.items():
        assert s == 1 + sum(sizes[c] for c, p in par.items() if p == n)


@pytest.mark.parametrize("last", [0, H.LAST])
def test_chain_cycles_and_hot_parent(spark, monkeypatch, last):
    monkeypatch.setattr(H, "LAST", last)
    monkeypatch.setattr(H, "RANGE", 64)
    monkeypatch.setattr(H.skew, "HOT_ROWS", 50)
    par = {f"c{i:02d}": f"c{i + 1:02d}" for i in range(40)} | {f"k{i}": "top" for i in range(200)}
    par |= {"x": "y", "y": "z", "z": "x", "t1": "t2", "t2": "y", "self": "self"}
    check(spark, par)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 30).map(str), st.integers(0, 30).map(str), min_size=1, max_size=30))
def test_any_links(spark, par):
    check(spark, par)


def test_nulls_empty_and_repeats(spark):
    s = "node string, parent string, depth int"
    assert H.hierarchy(spark.createDataFrame([], s)).count() == 0
    rows = [("a", "r", 7), ("a", "r", 7), ("a", "z", 1), (None, "r", 1), ("b", None, 1)]
    got = {(r.node, r.parent, r.root, r.depth) for r in H.hierarchy(spark.createDataFrame(rows, s)).collect()}
    assert got == {("a", "r", "r", 1), ("r", None, "r", 0)}


def test_sweep(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGE", 2)
    par = {"b": "a", "c": "b", "d": "b", "e": "a", "g": "f"}
    tree = H.hierarchy(spark.createDataFrame(list(par.items()), "node string, parent string"))
    assert {r.node: r.path for r in H.sweep(tree).collect()} == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > b > d", "e": "a > e", "f": "f", "g": "f > g"}
    pairs = {(r.ancestor, r.node, r.distance) for r in H.sweep(tree, pairs=True).collect()}
    assert pairs == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("b", "d", 1), ("a", "d", 2), ("a", "e", 1), ("f", "g", 1)}


def test_smallest_seq_is_the_parent(spark):
    rows = [(5, "n", "late", "derived_from"), (2, "n", "first", " CHUNKED-FROM"), (1, "n", "x", "references"), (None, "m", "y", "derived_via")]
    e = spark.createDataFrame(rows, "seq long, source string, target string, etype string")
    got = [tuple(r) for r in H.provenance_parents(e).collect()]
    assert ("n", "first") in got
