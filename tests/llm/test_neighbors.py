import numpy as np
import pytest

from quillgraph.llm import neighbors as N

SCHEMA = "vec_id long, vec array<float>, a string, id long, rank int"


def frame(spark, vecs, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "z", 0, 0) for i, v in zip(ids if ids is not None else range(len(vecs)), vecs)], SCHEMA)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_estimate_is_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x = unit(r.standard_normal((400, 96)).astype(np.float32))
    x[1::2] = unit(x[::2] + 0.6 * unit(r.standard_normal((200, 96)).astype(np.float32)))
    rot = N._rotation(96, 1)
    assert np.allclose(rot @ rot.T, np.eye(96), atol=1e-5)
    codes, scalars = N.encode(x, rot)
    est, err = N.Query(x, rot).estimate(codes, scalars)
    true = x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((est - true)[off].mean()) < 0.005
    assert (np.abs(est - true) <= err[None, :])[off].mean() > 0.97


def test_exact_on_few_vectors(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([unit(r.standard_normal((60, 16))), unit(r.standard_normal((60, 16)))])
    x[60:] = x[:60] + 0.2 * x[60:]
    got = N.nearest(frame(spark, x), 16, 5).toPandas()
    u = unit(x.astype(np.float32).astype(float))
    s = u @ u.T
    np.fill_diagonal(s, -9)
    hit = sum(len(set(g["neighbor"]) & set(np.argsort(-s[i])[:5])) for i, g in got.groupby("vec_id"))
    assert hit / (5 * 120) > 0.97
    assert np.allclose(got["cosine"], s[got["vec_id"], got["neighbor"]], atol=1e-6)


@pytest.mark.parametrize("block", [4096, 300])
def test_recall_over_cells_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    if block == 300:
        monkeypatch.setattr(N, "FLAT", 32)
    r = np.random.default_rng(3)
    base = unit(r.standard_normal((1500, 32)))
    x = np.concatenate([base, unit(base + 0.45 * unit(r.standard_normal((1500, 32)))), unit(base[:1] + 0.9 * unit(r.standard_normal((900, 32))))])
    got = {(a.vec_id_a, a.vec_id_b) for a in N.similar_pairs(frame(spark, x), 32, 0.85).collect()}
    u = unit(x.astype(np.float32).astype(float))
    s = np.triu(u @ u.T, 1)
    true = set(map(tuple, np.argwhere(s >= 0.85)))
    assert got <= true and len(got) >= 0.95 * len(true)


def test_unusable_empty_and_ties(spark):
    nan = float("nan")
    vecs = [[1, 0, 0], [1, 0, 0], [2, 0, 0], [0, 0, 0], [nan, 1, 0], [1, 0], None, [0, 1, 0], [0, 1, float("inf")], [None, 1, 0]]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, vec array<float>")
    got = sorted((r.vec_id_a, r.vec_id_b) for r in N.similar_pairs(df, 3, 0.9).collect())
    assert got == [(0, 1), (0, 2), (1, 2)]
    assert N.similar_pairs(df.limit(0), 3, 0.9).count() == 0
    assert N.nearest(df.where("vec_id > 2"), 3, 4, min_cosine=0.9).count() == 0


def test_a_third_are_copies(spark):
    r = np.random.default_rng(5)
    x = unit(r.standard_normal((300, 8)))
    x[:100] = x[0]
    x[299] = unit(x[:1] + 0.1 * x[298:299])[0]
    got = N.nearest(frame(spark, x), 8, 10, min_cosine=0.9).toPandas()
    lists = got.groupby("vec_id")["neighbor"].agg(list)
    assert lists[0] == list(range(1, 11)) and lists[50] == list(range(10)) and lists[5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert lists[299][:10] == list(range(10))
    assert got.groupby("vec_id").size().max() <= 10


def test_all_are_searched_without_a_threshold(spark, monkeypatch):
    r = np.random.default_rng(7)
    x = unit(r.standard_normal((5000, 32)).astype(np.float32))  # no clusters
    x[4990:] = x[:10]
    for part in (N.PART, 900):  # one part and several
        monkeypatch.setattr(N, "PART", part)
        got = N.nearest(frame(spark, x), 32, 10, exact=False).toPandas()
        s = x.astype(float) @ x.T.astype(float)
        np.fill_diagonal(s, -9)
        assert len(got) == 50_000 and got.groupby("vec_id").size().eq(10).all()
        hit = sum(len(set(g["neighbor"]) & set(np.argsort(-s[i])[:10])) for i, g in got.groupby("vec_id"))
        assert hit / 50_000 > 0.99
        assert np.allclose(got["cosine"], s[got["vec_id"], got["neighbor"]], atol=1e-3)


def test_grouped_centres():
    r = np.random.default_rng(9)
    heads = unit(r.standard_normal((30, 24)).astype(np.float32))
    many = unit(np.repeat(heads, 40, 0) + 0.15 * r.standard_normal((1200, 24)).astype(np.float32))
    r.shuffle(many)
    flat, grouped = N.Centres(many[:600], 600), N.Centres(many[:600], 100)
    assert flat.groups is None and sorted(np.concatenate(grouped.groups)) == list(range(600))
    a, b = flat.nearest(many[600:], 8), grouped.nearest(many[600:], 8)
    assert np.mean([len(set(x) & set(y)) for x, y in zip(a, b)]) > 7.5 and (a[:, 0] == b[:, 0]).mean() > 0.95
    assert N.probes_for(grouped, many[600:], 0.9) >= N.probes_for(flat, many[600:], 0.9) >= N.PROBES


def test_recall_counts(spark):
    r = np.random.default_rng(4)
    df = frame(spark, unit(r.standard_normal((200, 8))))
    full = N.nearest(df, 8, 10)
    assert tuple(N.recall(full, df, 8).first()) == (4, 40, 40)
    assert N.recall(full.where("rank > 3"), df, 8).first().hits == 28
    assert N.recall(full, df, 8, min_cosine=0.8).first().wanted < 40


@pytest.mark.parametrize("floor", [0.8, 0.6])
def test_pairs_at_the_threshold_share_a_cell(floor):
    r = np.random.default_rng(8)
    centres, units, x, off = (unit(r.standard_normal((1024, 96)).astype(np.float32)) for _ in range(4))
    probes = N.probes_for(centres, units, floor)
    off = unit(off - (off * x).sum(1, keepdims=True) * x)
    y = floor * x + np.sqrt(1 - floor**2) * off
    near = [np.argsort(-(v @ centres.T), axis=1)[:, :probes] for v in (x, y)]
    met = np.mean([bool(set(a) & set(b)) for a, b in zip(*near)])
    assert probes > N.PROBES and met >= 0.95
