"""A store: Parquet tables below one folder, each a list of folders that one manifest names.

A change writes folders of new rows, in proportion to what it brings, and then replaces the manifest
in one rename, so readers see all tables before or after a change, never in between. Rows are not
rewritten: what a change takes away is told by rows of its own (``gone`` paths up to a batch, ``cut``
edges), which readers join. ``optimize`` writes the tables anew without them; folders that no
manifest names are left to ``vacuum``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as X
from ..operators import answer, bm25, chunk, graph, quality, search, vector
from ..operators.synthesis import cluster_edges, cluster_nodes, derived_edges, document_nodes, file_answers, mark_stale, merge_entities, retrieved_edges
from ..operators.fuse import overlap_scorer
from ..scratch import delete
from ..session import ship
from ..sources import files, parse

SCHEMAS = {
    "chunks": "path string, domain string, doc_path string, kind string, body string, heading string, position int, total int, strategy string, source string, "
    "source_hash string, sources array<string>, stale boolean, has_provenance boolean, written_at timestamp, batch int",
    "edges": "seq long, source string, target string, etype string, metadata string, created_at timestamp",
    "ledger": "source_path string, content_hash string, domain string, doc_path string, processed_at timestamp, batch int",
    "vectors": "path string, domain string, vec array<float>, dims int, model string, content_hash string, batch int",
    "postings": "term string, path string, tf int, batch int",
    "stats": "path string, dl int, kind string, stale boolean, batch int",
    "gone": "path string, upto int",
    "cut": "seq long",
    "hyde": "query_hash string, passage string",
    "rules": "ord int, pattern string, domain string",
    "config": "key string, value string",
}
#: Tables whose rows go with the path of their chunk.
BY_PATH = ("chunks", "vectors", "postings", "stats")


def is_on(value: str) -> bool:
    return value.strip().lower() not in ("", "false", "off", "no", "none", "0")


class Store:
    """Ingest, search, answer and maintain; every method is a plan over the store's tables.

    ``scorer``: an expression of query and content for reranking; by default the share of the query's
    words that the content has.
    """

    def __init__(self, spark: SparkSession, root: str, *, embedder: vector.Embedder | None = None, llm: answer.LLM | None = None, extractors=None, scorer=None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.llm, self.extractors, self.scorer = embedder, llm, extractors, scorer
        ship(spark)

    # tables

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        path, fs = self._fs(f"{self.root}/manifest.json")
        if not fs.exists(path):
            return {"batch": 0, "seq": 0, "tables": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(path.toString()).collect()))

    def _publish(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        draft, fs = self._fs(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._fs(f"{self.root}/manifest.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(draft), fs.makeQualified(final), options)

    def _rows(self, name: str, manifest: dict) -> DataFrame:
        folders = manifest["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{f}" for f in folders))

    def table(self, name: str) -> DataFrame:
        """The rows that count."""
        m = self._manifest()
        rows = self._rows(name, m)
        if name in BY_PATH:
            if m["tables"].get("gone"):
                gone = self._rows("gone", m).groupBy("path").agg(F.max("upto").alias("upto"))
                rows = rows.join(gone, "path", "left").where(F.col("batch") >= F.coalesce("upto", F.lit(0))).drop("upto")
            return rows.drop("batch")
        if name == "edges" and m["tables"].get("cut"):
            return rows.join(self._rows("cut", m), "seq", "left_anti")
        if name == "ledger":  # the last row of a source; without a hash it is gone
            last = rows.groupBy("source_path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "source_path")), F.struct("batch", "processed_at", "content_hash")).alias("r"))
            return last.select("source_path", "r.*").where(F.col("content_hash").isNotNull()).drop("batch")
        return rows

    def change(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Add rows to tables and put others in the place of whole tables, in one step."""
        m = self._manifest()
        batch = m["batch"] + 1
        for mode, tables in (("append", append or {}), ("replace", replace or {})):
            for name, rows in tables.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                empty = self.spark.createDataFrame([], SCHEMAS[name])
                stamps = {"batch": F.lit(batch), "upto": F.lit(batch)}
                if name == "edges" and "seq" not in rows.columns:
                    rows = rows.withColumn("seq", F.lit(m["seq"] + 1) + F.monotonically_increasing_id())
                cast = rows.select(*(stamps.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))
                cast.write.parquet(f"{self.root}/{folder}")
                if name == "edges":
                    last = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}").agg(F.max("seq")).first()[0]
                    m["seq"] = max(m["seq"], last or 0)
                m["tables"][name] = [*(m["tables"].get(name, []) if mode == "append" else []), folder]
        self._publish(m | {"batch": batch})

    def append(self, name: str, rows: DataFrame) -> None:
        self.change({name: rows})

    def replace(self, name: str, rows: DataFrame) -> None:
        self.change(None, {name: rows})

    def optimize(self) -> None:
        """Write the tables anew, without the rows that no longer count."""
        none = {n: self.spark.createDataFrame([], SCHEMAS[n]) for n in ("gone", "cut")}
        self.change(None, {n: self.table(n) for n in (*BY_PATH, "edges", "ledger")} | none)

    def vacuum(self) -> None:
        """Delete the folders that the manifest does not name. Not while others read."""
        m = self._manifest()
        for name in SCHEMAS:
            keep = {f.rpartition("/")[2] for f in m["tables"].get(name, [])}
            path, fs = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in keep:
                    delete(self.spark, s.getPath().toString())

    # settings

    def init(self) -> Store:
        """Make the store if it is not there; what is there stays."""
        if not self._manifest()["tables"].get("config"):
            self.replace("config", self.spark.createDataFrame(list(config.DEFAULTS.items()), SCHEMAS["config"]))
        return self

    def config(self) -> dict[str, str]:
        return config.DEFAULTS | {r.key: r.value for r in self.table("config").collect() if r.value}

    def set(self, key: str, value: str) -> None:
        if "." not in key:
            raise ValueError("a setting is named section.key")
        new = self.spark.createDataFrame([(key, value)], SCHEMAS["config"])
        self.replace("config", self.table("config").where(F.col("key") != key).unionByName(new))

    def set_rules(self, text: str) -> None:
        self.replace("rules", self.spark.createDataFrame(files.parse_rules(text), SCHEMAS["rules"]))

    # ingest

    def add(self, path: str, domain: str | None = None) -> dict[str, int]:
        """Ingest the files below a path. ``domain`` 'auto' asks the rules; None is no domain."""
        return self.add_sources(files.scan(self.spark, path).select("path", "content"), domain)

    def _named(self, fresh: DataFrame) -> DataFrame:
        """``fresh`` (path, domain) with ``doc_path``: domain and file name, and a hash of the path where another source has that name.

        A source keeps the name it has; a free name goes to the smallest path of a batch.
        """
        held = self.table("ledger")
        name = X.sanitize(F.regexp_replace(X.file_name("path"), r"(?<=.)\.[^.]*$", ""))
        plain = F.when(F.col("domain") == "", name).otherwise(F.concat("domain", F.lit("/"), name))
        own = held.select(F.col("source_path").alias("path"), "domain", F.col("doc_path").alias("has"))
        rows = fresh.withColumn("plain", plain).join(own, ["path", "domain"], "left")
        first = rows.where(F.col("has").isNull()).groupBy("plain").agg(F.min("path").alias("first"))
        taken = held.select(F.col("doc_path").alias("plain")).distinct().withColumn("taken", F.lit(True))
        rows = rows.join(first, "plain", "left").join(taken, "plain", "left")
        free = (F.col("path") == F.col("first")) & F.col("taken").isNull()
        doc = F.coalesce("has", F.when(free, F.col("plain")).otherwise(F.concat("plain", F.lit("-"), X.short_hash("path"))))
        return rows.withColumn("doc_path", doc).drop("plain", "has", "first", "taken")

    def _put(self, rows: DataFrame, gone: DataFrame | None, more: dict[str, DataFrame]) -> None:
        """Add chunk rows with their postings, stats and vectors, take away what ``gone`` (path) had before, and add rows to other tables."""
        new = {"chunks": rows, "postings": bm25.postings(rows), "stats": bm25.document_stats(rows)} | more
        if self.embedder:
            new["vectors"] = vector.embed(rows, self.embedder, known=self.table("vectors"))
        if gone is not None:  # written first, or not at all where nothing is replaced
            gone = gone.select("path").distinct().persist()
            if not gone.isEmpty():
                new["gone"] = gone
        self.change(new)
        if gone is not None:
            gone.unpersist()

    def add_sources(self, sources: DataFrame, domain: str | None = None) -> dict[str, int]:
        """Ingest sources (path, content as bytes): parse, chunk, and replace what these sources had before.

        Sources whose path and content the ledger knows are skipped. Documents are named by domain and
        file name, and by a hash of the path where names clash (``_named``). Of several contents of a
        path in a batch the one of largest hash counts. An empty file is one empty chunk. Writes are in
        proportion to the sources; only their old paths are read from the store.
        """
        settings, now = self.config(), F.current_timestamp()
        hashed = sources.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["path", "content_hash"])
        fresh = files.unprocessed(hashed, self.table("ledger"))
        if domain == "auto":
            fresh = files.apply_rules(fresh, self.table("rules"))
        else:
            fresh = fresh.withColumn("domain", F.lit(domain or ""))
        w = Window.partitionBy("path").orderBy(F.desc("content_hash"))
        chosen = self._named(fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n"))
        parsed = parse.parse(chosen, self.extractors).withColumn("strategy", chunk.strategy_for(F.col("ftype"), settings["general.chunk_strategy"])).drop("content").persist()
        made = chunk.chunk_documents(parsed, int(settings["general.chunk_size"]), int(settings["general.chunk_overlap"]))
        made = made.select(
            chunk.chunk_path(F.lit(""), F.col("doc_path"), F.col("position")).alias("path"), "domain", "doc_path", F.lit("chunk").alias("kind"), "body", "heading",
            "position", "total", "strategy", F.col("path").alias("source"), F.col("content_hash").alias("source_hash"), F.array().cast("array<string>").alias("sources"),
            F.lit(False).alias("stale"), F.lit(True).alias("has_provenance"), now.alias("written_at"),
        ).persist()
        n_files, n_chunks, n_all = parsed.count(), made.count(), sources.count()
        if n_files:
            docs, of = parsed.select("doc_path").distinct(), parsed.select("path").distinct()
            chunks = self.table("chunks")
            old = chunks.where(F.col("kind") == "chunk").join(of.select(F.col("path").alias("source")), "source", "left_semi").select("path")
            nodes = chunks.where((F.col("kind") != "chunk") & ~F.coalesce("stale", F.lit(False)))
            aged = mark_stale(nodes, docs).where("stale").select(*made.columns)
            dead = self.table("edges").where(F.col("etype") == "chunked_from").join(of.select(F.col("path").alias("target")), "target", "left_semi").select("seq")
            links = made.select(F.col("path").alias("source"), F.col("source").alias("target"), F.lit("chunked_from").alias("etype"), F.lit("").alias("metadata"), now.alias("created_at"))
            ledger = parsed.select(F.col("path").alias("source_path"), "content_hash", "domain", "doc_path", now.alias("processed_at"))
            rows = made.unionByName(aged).persist()
            self._put(rows, old.unionByName(aged.select("path")), {"edges": links, "ledger": ledger} | ({} if dead.isEmpty() else {"cut": dead}))
            rows.unpersist()
        wanted = tuple(x.strip() for x in settings["synthesis.on_ingest"].split(",") if is_on(x))
        if n_files and self.llm and wanted and is_on(settings["synthesis.enabled"]):
            nodes = document_nodes(made, self.llm, parts=wanted).persist()
            self._put_nodes(nodes, derived_edges(nodes))
            nodes.unpersist()
        parsed.unpersist()
        made.unpersist()
        if n_files and is_on(settings["edges.auto_relate"]):
            self.relate()
        return {"files": n_files, "chunks": n_chunks, "skipped": n_all - n_files}

    def _put_nodes(self, nodes: DataFrame, links: DataFrame) -> None:
        """Add synthesis nodes (path, kind, body, sources, source_hashes), entities merged with those of the same path, and their edges."""
        chunks = self.table("chunks")
        old = chunks.where(F.col("kind") != "chunk").join(nodes.select("path"), "path", "left_semi")
        is_summary = F.col("kind").isin("summary", "synthesis", "answer")
        hashes = F.array().cast("array<string>").alias("source_hashes")
        whole = nodes.where(is_summary).unionByName(merge_entities(old.where(~is_summary).select("path", "kind", "body", "sources", hashes), nodes.where(~is_summary)))
        rows = whole.join(nodes.select("path").distinct(), "path", "left_semi").drop("source_hashes")
        none = {c: F.lit(None) for c in ("heading", "position", "total", "strategy", "source", "source_hash")}
        place = {"domain": X.domain_of("path"), "doc_path": F.regexp_replace("path", "/[^/]*$", ""), "stale": F.lit(False), "has_provenance": F.lit(True), "written_at": F.current_timestamp()}
        rows = rows.withColumns(none | place).select(chunks.columns).persist()
        self._put(rows, old.select("path"), {"edges": links.withColumn("created_at", F.current_timestamp())})
        rows.unpersist()

    # queries

    def _expanded(self, query: str, settings: dict[str, str]) -> str:
        """What the vector arm looks for: a hypothetical answer, kept in the table ``hyde``, if that is set."""
        if not (is_on(settings["search.hyde"]) and self.llm):
            return query
        asked = bm25.one_query(self.spark, query)
        llm, system = self.llm, search.HYDE
        rows, new = search.hyde(asked, self.table("hyde"), lambda q: llm(system, q))
        new = new.persist()
        told = rows.first().expanded
        if not new.isEmpty():
            self.append("hyde", new)
        new.unpersist()
        return told

    def _searching(self, settings: dict[str, str]) -> dict:
        scorer = (self.scorer or overlap_scorer) if is_on(settings["search.rerank"]) else None
        return {
            "index": self.table("postings"), "stats": self.table("stats"), "boost": float(settings["synthesis.synthesis_boost"]), "scorer": scorer,
            "weights": (2 * float(settings["search.keyword_weight"]), 2 * float(settings["search.vector_weight"])),
        }

    def search(self, query: str, mode: str | None = None, *, domain: str = "", top: int | None = None, scorer=None) -> DataFrame:
        """(query_id, path, score, rank, explain, content, domain), from the stored index; ``mode`` is by default the setting."""
        s = self.config()
        mode = mode or s["search.default_mode"]
        if mode not in search.MODES:
            raise ValueError(f"mode is one of {search.MODES}")
        vec = self.embedder.embed([self._expanded(query, s)])[0] if self.embedder and mode != "keyword" else None
        row = self.spark.createDataFrame([(0, query, vec)], "query_id int, query string, vec array<float>")
        how = self._searching(s) | ({"scorer": scorer} if scorer else {})
        hits = search.search(self.table("chunks"), self.table("vectors") if vec else None, row, mode if vec else "keyword", top=top or int(s["search.top_k"]), domain=domain, **how)
        return search.hydrate(hits, self.table("chunks"))

    def ask(self, question: str, *, domain: str = "", template: str | None = None, use_llm: bool = True) -> answer.Answer:
        s = self.config()
        a = answer.ask(
            question, self.table("chunks"), self.table("edges"), self.table("vectors") if self.embedder else None, llm=self.llm if use_llm else None,
            embed=(lambda q: self.embedder.embed([self._expanded(q, s)])[0]) if self.embedder else None, crag=is_on(s["search.crag"]), max_retries=int(s["search.crag_max_retries"]),
            top=int(s["search.top_k"]), max_context=int(s["llm.max_context"]), domain=domain, template=template, how=self._searching(s),
        )
        if is_on(s["edges.record_queries"]) and a.sources:
            found = self.spark.createDataFrame([(_run_name(question), p) for p in a.sources], "query_id string, path string")
            self.append("edges", retrieved_edges(found, F.current_timestamp()).withColumn("created_at", F.current_timestamp()))
        if a.answer and is_on(s["synthesis.on_query"]):
            rows = file_answers(self.spark.createDataFrame([(question, a.answer, a.sources)], "question string, answer string, sources array<string>"))
            rows = rows.withColumn("source_hashes", F.array().cast("array<string>")).persist()
            self._put_nodes(rows, derived_edges(rows, "query"))
            rows.unpersist()
        return a

    def neighbors(self, node: str) -> DataFrame:
        return graph.neighbors(self.table("edges"), node)

    def trace(self, node: str) -> DataFrame:
        return graph.trace(self.table("edges"), self.spark.createDataFrame([(node,)], "node string"))

    def graph(self, domain: str = "") -> DataFrame:
        """(domains, documents, chunks, edges, edge_types), one row; the types in the order of their edges."""
        c = self.table("chunks")
        types = graph.edge_types(self.table("edges")).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "etype"))), lambda x: F.struct(x["etype"], -x["m"]))).alias("edge_types"))
        return graph.summary(c.where(F.col("domain") == domain) if domain else c, self.table("edges")).join(F.broadcast(types))  # one row each

    def link(self, source: str, target: str, etype: str = "references", metadata: str = "") -> None:
        row = self.spark.createDataFrame([(source, target, etype, metadata)], "source string, target string, etype string, metadata string")
        self.append("edges", row.withColumn("created_at", F.current_timestamp()))

    def relate(self, domain: str | None = None, threshold: float | None = None) -> int:
        """Link similar chunks; the number of new edges."""
        s = self.config()
        v = self.table("vectors")
        v = v.where(F.col("domain") == domain) if domain is not None else v
        width = v.agg(F.max("dims")).first()[0]
        if not width:
            return 0
        new = vector.relate(v.where(F.col("dims") == width), self.table("edges"), threshold or float(s["edges.relate_threshold"]), dims=width).persist()
        n = new.count()
        if n:
            self.append("edges", new.withColumn("created_at", F.current_timestamp()))
            if self.llm and is_on(s["synthesis.enabled"]) and "clusters" in s["synthesis.on_relate"]:
                related = self.table("edges").where(F.col("etype") == "related_to")
                nodes = cluster_nodes(graph.components(related.select(F.col("source").alias("a"), F.col("target").alias("b"))), self.table("chunks"), self.llm).persist()
                self._put_nodes(nodes.drop("contradicts"), cluster_edges(nodes))
                nodes.unpersist()
        new.unpersist()
        return n

    # care

    def quality(self, domain: str = "") -> DataFrame:
        """The report of ``operators.quality``, of one domain if it is given."""
        inside = lambda c: F.col(c).startswith(f"{domain}/") if domain else F.lit(True)
        e = self.table("edges").where(inside("source") | inside("target"))
        return quality.ratios(quality.counters(*(self.table(t).where(inside("path")) if t else e for t in ("chunks", "", "vectors", "postings"))))

    def verify(self, sources: DataFrame | None = None) -> DataFrame:
        """(finding, n). ``sources``: (path) of the files that are there, by default those of the ledger that are not known to be gone."""
        width = self.table("vectors").agg(F.coalesce(F.max("dims"), F.lit(0))).first()[0]
        ledger = self.table("ledger")
        paths = ledger.select(F.col("source_path").alias("path"))
        there = paths.join(self._vanished(paths), "path", "left_anti") if sources is None else sources
        return quality.verify(self.table("chunks"), self.table("edges"), self.table("vectors"), there, ledger, width)

    def repair(self) -> int:
        """Drop the edges whose source chunk is gone; how many there were."""
        dead = quality.dangling(self.table("edges"), self.table("chunks")).select("seq").persist()
        n = dead.count()
        if n:
            self.append("cut", dead)
        dead.unpersist()
        return n

    def _vanished(self, paths: DataFrame) -> DataFrame:
        """(path) of the files that their file system knows not to be there. What cannot be asked counts as there.

        Each folder is listed once, one after another; a path without a scheme is one of the driver's machine.
        """
        folder = F.regexp_replace("path", "/[^/]*$", "")
        asked, found = [], []
        for r in paths.select(folder.alias("f")).distinct().toLocalIterator():
            try:
                path, fs = self._fs((r.f or "/") if "://" in r.f or r.f.startswith("file:") else f"file://{r.f or '/'}")
                found += [(r.f, s.getPath().getName()) for s in fs.listStatus(path)]
                asked.append((r.f,))
            except Py4JJavaError as e:
                if e.java_exception.getClass().getName() == "java.io.FileNotFoundException":
                    asked.append((r.f,))
        named = paths.withColumn("f", folder).withColumn("n", X.file_name("path"))
        told = named.join(self.spark.createDataFrame(asked, "f string"), "f", "left_semi")
        return told.join(self.spark.createDataFrame(found, "f string, n string"), ["f", "n"], "left_anti").select("path")

    def gc(self, exists: Callable[[list[str]], list[bool]] | None = None) -> dict[str, int]:
        """``repair``, and drop the ledger rows whose file is gone, as the file systems or ``exists`` (paths to flags) tell."""
        dropped = self.repair()
        paths = self.table("ledger").select(F.col("source_path").alias("path"))
        if exists is None:
            gone = self._vanished(paths)
        else:
            there = F.pandas_udf(lambda p: pd.Series(exists(list(p))), "boolean")
            gone = paths.where(~there("path"))
        gone = gone.persist()
        n = gone.count()
        if n:
            self.append("ledger", gone.select(F.col("path").alias("source_path"), F.current_timestamp().alias("processed_at")))
        gone.unpersist()
        return {"edges": dropped, "ledger": n}

    def reindex(self, what: str = "all") -> None:
        """Rebuild the postings and the vectors."""
        if what not in ("all", "bm25", "vectors"):
            raise ValueError("reindex all, bm25 or vectors")
        chunks = self.table("chunks")
        new = {"postings": bm25.postings(chunks), "stats": bm25.document_stats(chunks)} if what != "vectors" else {}
        if what != "bm25" and self.embedder:
            new["vectors"] = vector.embed(chunks, self.embedder)
        if new:
            self.change(None, new)


def _run_name(question: str) -> str:
    """A short name of a question in a query run."""
    return hashlib.sha256(question.encode()).hexdigest()[:8]
