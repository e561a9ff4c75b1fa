import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import answer, context, graph, quality, synthesis

EDGE = "seq long, source string, target string, etype string, metadata string"


def edges(spark, rows):
    return spark.createDataFrame([(i + 1, *r, "") for i, r in enumerate(rows)], EDGE)


def chain(spark, rows, start):
    t = graph.trace(edges(spark, rows), spark.createDataFrame([(start,)], "node string"))
    return [(r.node, r.parent, r.etype) for r in t.orderBy("step").collect()]


def test_trace(spark):
    rows = [("chunk/01.txt", "doc/original.txt", "chunked_from"), ("doc/original.txt", "source/root.txt", "derived_via"), ("chunk/01.txt", "other", "derived_from"), ("chunk/01.txt", "x", "references")]
    got = chain(spark, rows, "chunk/01.txt")
    assert got == [("chunk/01.txt", "doc/original.txt", "chunked_from"), ("doc/original.txt", "source/root.txt", "derived_via"), ("source/root.txt", None, "origin")]
    cycle = chain(spark, [("A", "B", "chunked_from"), ("B", "C", "chunked_from"), ("C", "A", "chunked_from")], "A")
    assert [x[0] for x in cycle] == ["A", "B", "C"] and all(x[2] != "origin" for x in cycle)
    long = [(f"node_{i:02d}", f"node_{i + 1:02d}", "chunked_from") for i in range(24)]
    t = graph.trace_all(edges(spark, long)).where("start = 'node_00'").orderBy("step").collect()
    assert len(t) == 25 and t[-1].etype == "origin" and t[3].node == "node_03"


def test_neighbors_and_summary(spark):
    e = edges(spark, [("node_x", "a", "references"), ("node_xy", "node_x", "related_to"), ("s", "s", "references")])
    assert sorted(tuple(r)[:3] for r in graph.neighbors(e, "node_x").collect()) == [("incoming", "node_xy", "related_to"), ("outgoing", "a", "references")]
    assert graph.neighbors(e, "s").count() == 2 and graph.neighbors(e, "node").count() == 0
    c = spark.createDataFrame([("d1/a/01.txt",), ("d1/a/02.txt",), ("d2/b/01.txt",), ("d2/b/_summary.txt",)], "path string")
    assert tuple(graph.summary(c, e).first()) == (2, 2, 3, 3)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=20))
def test_components(spark, pairs):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    label = {str(x): {str(x)} for p in pairs for x in p}
    for a, b in pairs:
        both = label[str(a)] | label[str(b)]
        for x in both:
            label[x] = both
    want = {(min(s), x, len(s)) for x, s in label.items() if len(s) >= 3}
    assert {tuple(r) for r in graph.components(df).collect()} == want


def test_expand(spark):
    res = spark.createDataFrame([("a", 1.0, 1), ("b", 0.5, 2)], "path string, score double, rank int")
    e = edges(spark, [("b", "x", "related_to"), ("a", "x", "references"), ("a", "b", "references"), ("a", "gone", "references"), ("a", "y", "chunked_from"), ("b", "z", "derived_from")])
    c = spark.createDataFrame([(p,) for p in "abxyz"], "path string")
    assert sorted(tuple(r) for r in graph.expand(res, e, c).collect()) == [("x", 0.8, 3), ("z", 0.4, 4)]
    assert graph.expand(res, e, c, parents=1).count() == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=12), st.integers(0, 60))
def test_budget_is_a_loop_that_stops(spark, words, limit):
    rows = [(f"p{i:02d}", 1.0, i + 1, "w " * n) for i, n in enumerate(words)]
    df = spark.createDataFrame(rows, "path string, score double, rank int, content string")
    want, used = [], 0
    for p, _, _, t in rows:
        used += int(len(t.split()) * 1.3)
        if used > limit:
            break
        want.append(p)
    assert [r.path for r in context.within_budget(df, limit).orderBy("rank").collect()] == want


def test_context_and_sources(spark):
    df = spark.createDataFrame([("a/1.txt", 0.51239, 1, "one"), ("b/2.txt", 0.4, 2, "two\nlines")], "path string, score double, rank int, content string")
    r = context.assemble(df, 100).first()
    assert r.context == "--- Source: a/1.txt (score: 0.5124) ---\none\n\n--- Source: b/2.txt (score: 0.4000) ---\ntwo\nlines"
    assert spark.createDataFrame([(r.context,)], "c string").select(context.sources_in(F.col("c"))).first()[0] == ["a/1.txt", "b/2.txt"] == r.sources


def test_ask_retries(spark):
    c = spark.createDataFrame([("d/a/01.txt", "d", "the fox den", "chunk", False), ("d/b/01.txt", "d", "the owl nest", "chunk", False)], "path string, domain string, body string, kind string, stale boolean")
    e = edges(spark, [("d/a/01.txt", "d/b/01.txt", "references")])
    said = []

    def llm(system, user):
        said.append(system)
        if "judge" in system:
            return "PARTIAL: owls" if len(said) < 2 else "SUFFICIENT"
        return "owl" if "search quer" in system else "An answer"

    a = answer.ask("fox", c, e, llm=llm, crag=True)
    assert (a.answer, a.attempts, a.confidence) == ("An answer", 2, "sufficient") and set(a.sources) == {"d/a/01.txt", "d/b/01.txt"}
    plain = answer.ask("fox", c, e)
    assert plain.answer is None and plain.sources == ["d/a/01.txt", "d/b/01.txt"] and plain.attempts == 1
    assert answer.ask("zebra", c, e, llm=llm).sources == []
    assert answer.wrap("q", "c", "{question}|{context}") == "q|c" and answer.judge("q", "c", lambda s, u: "no") == ("insufficient", "")


def test_synthesis(spark):
    raw = ['```json\n[{"name": "A", "type": "person", "description": "x"}, {"name": "B"}, 5]\n```', "not json", None, "[]"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    names = [[e.name for e in x[0]] for x in df.select(synthesis.parse_entities("r")).collect()]
    assert names[1:] == [[], [], []]
    s = spark.createDataFrame([("text\nCONTRADICTS: x\nmore\ncontradicts: a, b",), ("plain",)], "r string").select(synthesis.parse_synthesis("r").alias("s")).collect()
    assert (s[0].s.body, s[0].s.contradicts) == ("text\nmore", ["a", "b"]) and (s[1].s.body, s[1].s.contradicts) == ("plain", [])
    nodes = spark.createDataFrame([("d/a/_summary.txt", ["d/a/01.txt"], False), ("_queries/_answer_1.txt", ["d/a/02.txt"], False), ("d/b/_summary.txt", ["d/a/01.txt"], False), ("d/a/01.txt", [], None)], "path string, sources array<string>, stale boolean")
    docs = spark.createDataFrame([("d/a",)], "doc_path string")
    assert {r.path for r in synthesis.mark_stale(nodes, docs).where("stale").collect()} == {"d/a/_summary.txt", "_queries/_answer_1.txt"}


def test_quality_of_an_empty_store(spark):
    c = spark.createDataFrame([], "path string, has_provenance boolean, stale boolean")
    e, p = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([], "path string")
    assert quality.ratios(quality.counters(c, e, p, p)).first().overall_score == pytest.approx(2 / 6)
    c = spark.createDataFrame([("d/a/01.txt", True, None), ("d/b/01.txt", False, None), ("d/b/_summary.txt", True, True)], "path string, has_provenance boolean, stale boolean")
    q = quality.ratios(quality.counters(c, e, p, p)).first()
    assert (q.documents, q.chunks, q.orphan_rate, q.stale_rate, q.provenance_coverage) == (2, 2, 1.0, 1.0, 0.5)


def test_garbage(spark):
    e = edges(spark, [("ok.txt", "x", "t"), ("gone.txt", "ok.txt", "t"), ("query_1", "gone.txt", "t")])
    c = spark.createDataFrame([("ok.txt",), ("ok.txt",)], "path string")
    assert quality.dangling(e, c).count() == 1 and quality.dangling(e, c, "target").count() == 1
    assert sorted(r.source for r in quality.collect_garbage(e, c).collect()) == ["ok.txt", "query_1"]
