import json

from quillgraph import __main__ as cli
from quillgraph.operators.vector import HashEmbedder
from quillgraph.plans.store import Store
from quillgraph.streaming import ingest


def put(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_store(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {"guide.md": "# Foxes\nThe fox sleeps in a den.\n# Owls\nThe owl has a nest.", "app.py": "def fox():\n    return 1\n", "empty.txt": "", ".hidden": "x", ".git/config": "x", "data.json": '{"fox": {"age": 3}}'})
    s = Store(spark, str(tmp_path / "store"), embedder=HashEmbedder(16)).init()
    assert s.add(str(src)) == {"files": 4, "chunks": 5, "skipped": 0}
    assert s.add(str(src)) == {"files": 0, "chunks": 0, "skipped": 4}
    paths = {r.path: r for r in s.table("chunks").collect()}
    assert set(paths) == {"guide/01.txt", "guide/02.txt", "app/01.txt", "data/01.txt", "empty/01.txt"}
    assert paths["empty/01.txt"].body == ""
    assert paths["guide/02.txt"].heading == "# Owls" and paths["data/01.txt"].body == "fox.age: 3" and paths["guide/01.txt"].total == 2
    assert s.search("fox", "keyword").orderBy("rank").first().path in ("app/01.txt", "data/01.txt", "guide/01.txt")
    assert s.search("owl nest", top=1).first().path == "guide/02.txt"
    assert [r.etype for r in s.trace("guide/01.txt").orderBy("step").collect()] == ["chunked_from", "origin"]
    put(src, {"guide.md": "# Foxes\nOnly foxes."})
    assert s.add(str(src))["files"] == 1
    assert s.table("chunks").where("doc_path = 'guide'").count() == 1 and s.table("postings").where("path = 'guide/02.txt'").count() == 0
    assert s.table("edges").where("source like 'guide/%'").count() == 1 and s.table("vectors").where("path like 'guide/%'").count() == 1
    s.link("guide/01.txt", "app/01.txt")
    s.link("guide/09.txt", "app/01.txt")
    assert s.neighbors("app/01.txt").where("etype = 'references'").count() == 2
    assert {r.finding: r.n for r in s.verify().collect()}["orphan_edges"] == 1
    assert s.gc() == {"edges": 1, "ledger": 0} and s.table("edges").where("etype = 'references'").count() == 1
    (src / "app.py").unlink()
    assert s.gc()["ledger"] == 1
    assert s.quality().first().documents == 4 and s.quality("none").first().documents == 0
    s.set("search.top_k", "1")
    assert s.search("fox", "keyword").count() == 1
    s.reindex()
    s.vacuum()
    s.optimize()
    s.vacuum()
    assert s.table("chunks").count() == 4 and s.graph().first().chunks == 4 and s.search("fox", "keyword").count() == 1
    assert s.graph().first().edge_types == {"chunked_from": 4, "references": 1}


def test_sources_of_one_name_and_changes_in_proportion(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {"a/readme.md": "alpha", "b/readme.md": "beta", "c/other.md": "gamma"})
    s = Store(spark, str(tmp_path / "store"), embedder=HashEmbedder(16)).init()
    bodies = lambda: {r.source.split("/")[-2] + ":" + r.body for r in s.table("chunks").collect()}
    assert s.add(str(src))["files"] == 3 and bodies() == {"a:alpha", "b:beta", "c:gamma"}
    names = {r.source.split("/")[-2]: r.path for r in s.table("chunks").collect()}
    assert names["a"] == "readme/01.txt" and names["b"].startswith("readme-") and len(set(names.values())) == 3
    before = s._manifest()["tables"]
    put(src, {"b/readme.md": "beta two"})
    assert s.add(str(src))["files"] == 1 and bodies() == {"a:alpha", "b:beta two", "c:gamma"}
    put(src, {"0/readme.md": "delta"})  # a smaller path does not take a name that is held
    assert s.add(str(src))["files"] == 1 and bodies() == {"a:alpha", "b:beta two", "c:gamma", "0:delta"}
    assert {r.source.split("/")[-2]: r.path for r in s.table("chunks").where("body not like 'delta%'").collect()} == names
    after = s._manifest()["tables"]
    assert all(after[t][: len(before[t])] == before[t] for t in before)  # nothing was written anew
    new = spark.read.parquet(*(f"{s.root}/{f}" for f in after["chunks"][len(before["chunks"]) :]))
    assert new.count() == 2 and s.table("postings").where("term = 'beta'").count() == 1 and s.table("vectors").count() == 4
    assert s.table("ledger").count() == 4 and s.search("two", "keyword").first().path == names["b"]


def test_gc_keeps_what_cannot_be_asked(spark, tmp_path):
    (tmp_path / "here").mkdir()
    put(tmp_path / "here", {"x.txt": "x"})
    s = Store(spark, str(tmp_path / "store")).init()
    rows = [("nosuch://host/x/a.txt", b"one"), (f"{tmp_path}/here/x.txt", b"two"), (f"{tmp_path}/here/y.txt", b"three"), (f"file:{tmp_path}/away/z.txt", b"four")]
    s.add_sources(spark.createDataFrame(rows, "path string, content binary"))
    assert s.gc() == {"edges": 0, "ledger": 2}
    assert {r.source_path.split("/")[-1] for r in s.table("ledger").collect()} == {"a.txt", "x.txt"}
    assert s.gc(lambda paths: [not p.endswith("x.txt") for p in paths])["ledger"] == 1


def test_settings_have_an_effect(spark, tmp_path):
    said = []

    def llm(system, user):
        said.append(system)
        return "the owl has a nest" if "passage" in system else "Said"

    put(tmp_path / "src", {"fox.txt": "the fox sleeps in a den", "owl.txt": "the owl has a nest", "both.txt": "the fox and the owl"})
    s = Store(spark, str(tmp_path / "store"), embedder=HashEmbedder(64), llm=llm).init()
    s.set("edges.auto_relate", "true")
    s.set("edges.relate_threshold", "0.2")
    s.add(str(tmp_path / "src"))
    assert s.table("edges").where("etype = 'related_to'").count() > 0
    assert set(s.search("fox").first().explain) == {"bm25", "vector", "rrf"}
    s.set("search.default_mode", "keyword")
    assert set(s.search("fox").first().explain) == {"bm25"}
    s.set("search.hyde", "true")
    for _ in range(2):
        assert s.search("where", "vector", top=1).first().path == "owl/01.txt"
    assert s.table("hyde").count() == 1
    s.set("search.rerank", "true")
    assert "reranker" in s.search("fox", "hybrid").first().explain
    s.set("edges.record_queries", "true")
    s.set("synthesis.on_query", "on")
    a = s.ask("fox den")
    assert s.table("edges").where("etype = 'retrieved'").count() == len(a.sources)
    node = s.table("chunks").where("kind = 'answer'").first()
    assert s.table("vectors").where(f"path = '{node.path}'").count() == 1 and s.table("postings").where(f"path = '{node.path}'").count() > 0
    assert s.ask("fox den", use_llm=False).answer is None


def test_rules_relate_and_ask(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {"auth/login.md": "the login page and the token", "auth/other.md": "the login page and the token now", "docs/x.txt": "weather report"})
    s = Store(spark, str(tmp_path / "store"), embedder=HashEmbedder(64), llm=lambda system, user: "Said").init()
    s.set_rules("auth -> security")
    s.add(str(src), "auto")
    assert {r.domain for r in s.table("chunks").collect()} == {"security", "unsorted"}
    assert s.relate(threshold=0.7) == 1 and s.relate(threshold=0.7) == 0
    s.set("synthesis.on_query", "true")
    a = s.ask("login token")
    assert a.answer == "Said" and a.sources[0].startswith("security/")
    assert s.table("chunks").where("kind = 'answer'").count() == 1 and s.table("edges").where("metadata = 'query'").count() == len(a.sources)


def test_synthesis(spark, tmp_path):
    def llm(system, text):
        if "JSON" in system:
            return '[{"name": "Red Fox", "type": "animal", "description": "sly"}]'
        return "All foxes.\nCONTRADICTS: c/01.txt" if "CONTRADICTS" in system else "A summary."

    put(tmp_path / "src", {f"{n}.txt": "the red fox sleeps in the den" for n in "abc"})
    s = Store(spark, str(tmp_path / "store"), embedder=HashEmbedder(16), llm=llm).init()
    s.set("synthesis.enabled", "true")
    s.add(str(tmp_path / "src"))
    kinds = {r.path: r.kind for r in s.table("chunks").collect()}
    assert kinds["a/_summary.txt"] == "summary" and kinds["b/_animal_red_fox.txt"] == "animal" and len(kinds) == 9
    assert s.table("edges").where("etype = 'derived_from'").count() == 6
    assert s.relate() == 3
    made = s.table("chunks").where("kind = 'synthesis'").collect()
    assert len(made) == 1 and made[0].body == "All foxes." and made[0].path.startswith("_synthesis/_synth_")
    edges = sorted((r.etype, r.target) for r in s.table("edges").where("metadata = 'cluster'").collect())
    assert edges == [("contradicts", "c/01.txt"), *(("synthesizes", f"{n}/01.txt") for n in "abc")]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store")).init()
    rows = spark.createDataFrame([("a.txt", "one text"), ("b.txt", "other text"), ("a.txt", "one text")], "path string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, s, str(tmp_path / f"check{n}")).awaitTermination()
        assert s.table("chunks").count() == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local", lambda: spark)
    put(tmp_path / "src", {"a.txt": "the fox"})
    run = lambda *a: (cli.main(["--store", str(tmp_path / "s"), *a]), json.loads(capsys.readouterr().out))[1]
    assert run("add", str(tmp_path / "src"))["files"] == 1
    assert run("search", "fox", "--mode", "keyword")[0]["path"] == "a/01.txt"
    assert run("config", "search.top_k") == "10" and run("config", "search.top_k", "3") == "set" and run("config", "search.top_k") == "3"
    assert run("ask", "fox")["sources"] == ["a/01.txt"] and run("link", "a/01.txt", "b") == "linked"


def test_queries_and_sql_name_the_same(data):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
