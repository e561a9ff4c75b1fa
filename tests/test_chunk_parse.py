import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import text as X
from quillgraph.operators import chunk as C
from quillgraph.sources import files, parse

TEXT = st.text(alphabet="ab# .\n", max_size=200)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(0, 30))
def test_every_character_is_in_a_chunk(text, size, overlap):
    for name in C.STRATEGIES:
        got = C.chunk_text(text, name, size, overlap)
        assert got
        if name in ("heading", "function"):
            assert all(w in "\n".join(c for c, _ in got) for w in re.findall(r"[ab]+", text))
        if name == "fixed" and text.strip():
            assert all(len(c) <= size for c, _ in got)


def test_headings():
    t = "intro\n# One\naaa\n## Two\nbbb"
    assert C.by_heading(t, 1000, 0) == [("intro", ""), ("# One\naaa", "# One"), ("## Two\nbbb", "## Two")]
    assert C.by_heading(t, 1000, 3)[1] == ("tro\n# One\naaa", "# One")
    assert C.by_heading("a\nb\nc", 4, 1) == [("a\nb", ""), ("b\nc", "")]


def test_functions_paragraphs_and_windows():
    assert [c for c, _ in C.by_function("import x\ndef a():\n  1\n  def b():\n    2\nclass C:\n  3", 1000, 0)] == ["import x", "def a():\n  1", "  def b():\n    2", "class C:\n  3"]
    assert [c for c, _ in C.by_paragraph("aaa\n\nbbb\n \nccc", 8, 0)] == ["aaa\n\nbbb", "ccc"]
    assert [c for c, _ in C.by_paragraph("aaaa\n\nbbbb", 5, 2)] == ["aaaa", "aa\n\nbbbb"]
    assert [c for c, _ in C.by_window("abcdefgh", 4, 2)] == ["abcd", "cdef", "efgh"]
    assert [c for c, _ in C.by_window("abc", 1, 5)] == ["a", "b", "c"]
    assert C.chunk_text("", "heading") == [("", "")] and C.chunk_text("x", "none such") == [("x", "")]
    assert C.propositions("Short. This one is long enough! And so is this one?") == ["This one is long enough!", "And so is this one?"]
    assert C.by_proposition("# H\nfirst longer text here", 1000, 0, lambda t: "a proposition\nno\nanother one here") == [("a proposition", "# H"), ("another one here", "# H")]


def test_expressions_equal_the_folds(spark):
    texts = ["", "a", "x" * 1000, "y" * 1001, "word " * 700, "One is here. Two is there!  Three?", " \n ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in C.windows(df, 100, 30).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.body)
    assert got == {i: [c for c, _ in C.by_window(t, 100, 30)] for i, t in enumerate(texts) if t and t.strip()}
    said = {}
    for r in C.sentences(df).orderBy("id", "position").collect():
        said.setdefault(r.id, []).append(r.body)
    assert said == {i: C.propositions(t) for i, t in enumerate(texts) if t is not None}
    s = df.withColumn("strategy", F.lit("paragraph"))
    assert {(r.id, r.position, r.total) for r in C.chunk_documents(s).where("id in (0, 7)").collect()} == {(0, 1, 1), (7, 1, 1)}
    path = C.chunk_path(F.lit("d"), F.lit("doc"), F.col("id"))
    assert [r[0] for r in spark.createDataFrame([(3,), (120,)], "id int").select(path).collect()] == ["d/doc/03.txt", "d/doc/120.txt"]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t"))).first()[0]


def test_parsers(spark):
    assert one(spark, "<p>a<script>x\ny</script> <b>b &amp;</b></p>", parse.html_text) == "a b &amp;"
    assert one(spark, "name,v\nx,1\ny,\n", parse.csv_text) == "--- Record 1 ---\nname: x\nv: 1\n--- Record 2 ---\nname: y"
    assert one(spark, '{"a": {"b": [1, true, null]}, "c": "x"}', parse.json_text) == "a.b.0: 1\na.b.1: True\na.b.2: None\nc: x"
    assert one(spark, '{"a": 1}\n{"a": 2}', parse.json_text) == '{"a": 1}\n{"a": 2}'
    assert one(spark, "[" * 5000, parse.json_text) == "[" * 5000
    assert one(spark, "---\nt: x\n---\n\nbody", parse.strip_front_matter) == "body" and one(spark, "--- open", parse.strip_front_matter) == "--- open"
    assert [one(spark, p, parse.detect_type) for p in ("a/B.MD", "x.py", "y.tsv", "z", "q.weird")] == ["markdown", "code", "csv", "text", "text"]
    assert one(spark, b"ok \xff", X.valid_text, "binary") == "ok �"
    assert one(spark, "My Doc (1)!.md", X.sanitize) == "mydoc1.md" and one(spark, "!!", X.sanitize) == "document"
    f = spark.createDataFrame([("a.pdf", bytearray(b"%PDF")), ("b.docx", bytearray(b"zip")), ("c.json", bytearray(b"{}x"))], "path string, content binary")
    got = {r.path: r.text for r in parse.parse(f, {"pdf": lambda b: "read", "docx": lambda b: 1 / 0}).collect()}
    assert got == {"a.pdf": "read", "b.docx": "zip", "c.json": "{}x"}


def test_nodes(spark):
    raw = '---\ntype: summary\nsources: ["a", "b"]\nsource_hashes: oops\nstale: true\nposition: 1\n---\nbody\n---\nmore'
    r = parse.read_node(spark.createDataFrame([(raw,), ("---\n---\nx",), (None,)], "content string")).collect()
    assert (r[0].type, r[0].sources, r[0].source_hashes, r[0].stale, r[0].body) == ("summary", ["a", "b"], [], True, "body\n---\nmore")
    assert r[1].type is None and r[1].body == "---\n---\nx" and r[2].body is None


def test_rules_ledger_and_config(spark):
    rules = spark.createDataFrame(files.parse_rules("# c\nAuth login \u2192 security\n docs -> guides\n\nbad line"), "ord int, pattern string, domain string")
    p = spark.createDataFrame([("/x/LOGIN/docs.md",), ("/x/docs/a",), ("/x/b",)], "path string")
    assert [r.domain for r in files.apply_rules(p, rules).orderBy("path").collect()] == ["security", "unsorted", "guides"]
    src = spark.createDataFrame([("/a", "1"), ("/a", "2"), ("/x/a", "1")], "path string, content_hash string")
    led = spark.createDataFrame([("/a", "1")], "source_path string, content_hash string")
    assert {tuple(r) for r in files.unprocessed(src, led).collect()} == {("/a", "2"), ("/x/a", "1")}
    ini = "[general]\n# chunk_size = 1\nchunk_size = 5\nchunk_size = 6\n\n[llm]\nprovider = none\n"
    assert config.parse_ini(ini)["general.chunk_size"] == "5"
    assert config.parse_ini(config.set_ini(ini, "general.chunk_size", "9"))["general.chunk_size"] == "9"
    assert config.parse_ini(config.set_ini(ini, "general.x", "1")) | {"general.x": "1"} == config.parse_ini(config.set_ini(ini, "general.x", "1"))
    assert config.parse_ini(config.set_ini(ini, "new.k", "v"))["new.k"] == "v"
    with pytest.raises(ValueError):
        config.set_ini(ini, "flat", "v")
    t = spark.createDataFrame([(2, "a.b", "late"), (1, " a.b ", " 96 "), (0, "#a.b", "x"), (3, "c.d", None), (4, None, "y")], "ord int, key string, value string")
    assert config.from_table(t) == {"a.b": "96", "c.d": ""}


def test_packed_vectors(spark, tmp_path):
    v = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert (files.unpack_vectors(files.pack_vectors(v, "m")) == v).all()
    with pytest.raises(ValueError):
        files.unpack_vectors(files.pack_vectors(v, "m")[:-1])
    (tmp_path / "eng").mkdir()
    (tmp_path / "eng/embeddings.bin").write_bytes(files.pack_vectors(v, "m"))
    (tmp_path / "eng/manifest.tsv").write_text("a\t0\t32\t3\tabc\nb\t1\t44\t3\n")
    got = {r.path: (r.domain, r.vec, r.content_hash) for r in files.read_vectors(spark, str(tmp_path)).collect()}
    assert got == {"a": ("eng", [0.0, 1.0, 2.0], "abc"), "b": ("eng", [3.0, 4.0, 5.0], "")}
    (tmp_path / "log").write_text("# c\na\tb\tt\tm\n\nx\ty\nc\td\tt\n")
    assert {tuple(r) for r in files.read_edge_log(spark, str(tmp_path / "log")).collect()} == {("a", "b", "t", "m"), ("c", "d", "t", "")}
    assert files.malformed_lines(spark, str(tmp_path / "log")).count() == 1
