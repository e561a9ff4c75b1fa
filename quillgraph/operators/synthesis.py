"""Nodes made from chunks: summaries, entities, cluster syntheses, filed answers, and when they are stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

_ENTITY = "array<struct<name:string,type:string,description:string>>"


def parse_entities(raw: Column | str) -> Column:
    """Entities (name, type, description) in a model's answer: a JSON list, perhaps in code fences; without name or type they do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(X.col(raw)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    found = F.coalesce(F.from_json(bare, _ENTITY), F.array().cast(_ENTITY))
    return F.filter(found, lambda e: e.isNotNull() & e["name"].isNotNull() & e["type"].isNotNull())


def parse_synthesis(raw: Column | str) -> Column:
    """(body, contradicts): a cluster synthesis without its CONTRADICTS: lines, and the names on the last of them."""
    lines = F.split(X.col(raw), "\n")
    marked = F.filter(lines, lambda x: F.upper(F.trim(x)).startswith("CONTRADICTS:"))
    names = F.split(F.regexp_replace(F.trim(F.try_element_at(marked, F.lit(-1))), r"(?i)^CONTRADICTS:", ""), ",")
    clean = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "none"))
    body = F.array_join(F.filter(lines, lambda x: ~F.upper(F.trim(x)).startswith("CONTRADICTS:")), "\n")
    return F.struct(F.trim(body).alias("body"), F.coalesce(clean, F.array().cast("array<string>")).alias("contradicts"))


def entity_path(document: Column, kind: Column, name: Column) -> Column:
    """document/_type_name.txt, the name sanitized, of at most 50 characters."""
    clean = F.substring(X.sanitize(F.replace(name, F.lit(" "), F.lit("_"))), 1, 50)
    return F.concat(document, F.lit("/_"), kind, F.lit("_"), clean, F.lit(".txt"))


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, body, sources, source_hashes): new entities added to those of the same path.

    Sources and hashes are united; the bodies follow each other. Of new entities that share a path
    all bodies are kept in order.
    """
    gathered = new.groupBy("path", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("body")), "\n\n").alias("body"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_hashes")))).alias("source_hashes"),
    )
    o = old.select("path", F.col("kind").alias("k"), F.col("body").alias("b"), F.col("sources").alias("s"), F.col("source_hashes").alias("h"))
    none = F.array().cast("array<string>")
    union = lambda a, b: F.array_sort(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))
    both = o.join(gathered, "path", "full")
    return both.select(
        "path", F.coalesce("kind", "k").alias("kind"), F.concat_ws("\n\n", F.trim("b"), "body").alias("body"),
        union(F.col("s"), F.col("sources")).alias("sources"), union(F.col("h"), F.col("source_hashes")).alias("source_hashes"),
    )


def derived_edges(nodes: DataFrame, metadata: str = "ingest", etype: str = "derived_from") -> DataFrame:
    """(source, target, etype, metadata): an edge from each node (path, sources) to each of its sources."""
    return nodes.select(F.col("path").alias("source"), F.explode("sources").alias("target"), F.lit(etype).alias("etype"), F.lit(metadata).alias("metadata"))


def mark_stale(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes (path, sources, stale) with ``stale`` set where one of the documents (doc_path) came in again.

    That holds for nodes of the document itself and for filed answers and syntheses that name one of
    its chunks as a source. Matched by document, not by scanning all documents for each node.
    """
    docs = documents.select("doc_path").where(F.col("doc_path").isNotNull()).distinct()
    owner = F.regexp_replace("path", "/[^/]*$", "")
    far = F.col("path").startswith("_queries/") | F.col("path").startswith("_synthesis/")
    named = F.when(far, F.transform("sources", lambda s: F.regexp_replace(s, "/[^/]*$", ""))).otherwise(F.array(owner))
    hit = nodes.where(X.is_synthesis("path")).select("path", F.explode(F.array_distinct(named)).alias("doc_path")).join(docs, "doc_path", "left_semi").select("path").distinct()
    flagged = nodes.join(hit.withColumn("_hit", F.lit(True)), "path", "left")
    return flagged.withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def file_answers(answers: DataFrame) -> DataFrame:
    """(path, kind, body, sources): answers (question, answer, sources) as nodes named by a hash of the question."""
    path = F.concat(F.lit("_queries/_answer_"), X.short_hash("question"), F.lit(".txt"))
    body = F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer")
    w = Window.partitionBy("path").orderBy("answer")
    rows = answers.select(path.alias("path"), F.lit("answer").alias("kind"), body.alias("body"), "sources", "answer")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).select("path", "kind", "body", "sources")


def retrieved_edges(results: DataFrame, at: Column) -> DataFrame:
    """(source, target, etype, metadata): an edge from the query run to each path it found (query_id, path)."""
    stamp = F.unix_timestamp(at.cast("timestamp")).cast("string")
    return results.select(F.concat(F.lit("query_"), stamp, F.lit("_"), F.col("query_id").cast("string")).alias("source"), F.col("path").alias("target"), F.lit("retrieved").alias("etype"), stamp.alias("metadata"))


_SUMMARY = "You summarise the chunks of a document in a few sentences."
_ENTITIES = "You list the entities in a text as a JSON list of objects with name, type and description."
_CLUSTER = "You write what related chunks have in common. If some contradict the others, end with a line CONTRADICTS: and their paths."


def document_nodes(chunks: DataFrame, llm: Callable[[str, str], str], parts: tuple[str, ...] = ("summary", "entities")) -> DataFrame:
    """(path, kind, body, sources, source_hashes): a summary and the entities of each document (path, doc_path, position, body).

    The model reads a document's chunks in order; a document is one row of work. Blank answers make
    no node. ``parts``: which of both are made.
    """
    part = F.struct("position", "path", "body")
    docs = chunks.where(X.has_body("body")).groupBy("doc_path").agg(F.array_sort(F.collect_list(part)).alias("c"))
    docs = docs.select(
        "doc_path", F.array_join(F.transform("c", lambda x: x["body"]), "\n\n").alias("text"), F.transform("c", lambda x: x["path"]).alias("sources"),
        F.transform("c", lambda x: X.content_hash(x["body"])).alias("source_hashes"),
    )
    none = F.lit(None).cast("string")
    ask = lambda system: F.udf(lambda text: llm(system, text), "string")
    told = docs.select("doc_path", "sources", "source_hashes", (ask(_SUMMARY)("text") if "summary" in parts else none).alias("summary"), (ask(_ENTITIES)("text") if "entities" in parts else none).alias("raw"))
    summary = told.select(F.concat("doc_path", F.lit("/_summary.txt")).alias("path"), F.lit("summary").alias("kind"), F.col("summary").alias("body"), "sources", "source_hashes")
    each = told.select("doc_path", "sources", "source_hashes", F.explode(parse_entities("raw")).alias("e"))
    entity = each.select(entity_path(F.col("doc_path"), F.col("e.type"), F.col("e.name")).alias("path"), F.col("e.type").alias("kind"), F.coalesce("e.description", F.lit("")).alias("body"), "sources", "source_hashes")
    return summary.where(X.has_body("body")).unionByName(entity)


def cluster_nodes(found: DataFrame, chunks: DataFrame, llm: Callable[[str, str], str], min_size: int = 3) -> DataFrame:
    """(path, kind, body, sources, source_hashes, contradicts): a synthesis of each component (component, path) with enough chunks that are not blank."""
    rows = found.join(chunks.where(X.has_body("body")).select("path", "body"), "path")
    groups = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("path", "body"))).alias("c")).where(F.size("c") >= min_size)
    names = F.transform("c", lambda x: x["path"])
    text = F.array_join(F.transform("c", lambda x: F.concat(x["path"], F.lit(":\n"), x["body"])), "\n\n")
    made = groups.select(names.alias("sources"), F.transform("c", lambda x: X.content_hash(x["body"])).alias("source_hashes"), F.udf(lambda t: llm(_CLUSTER, t), "string")(text).alias("raw"))
    said = made.where(X.has_body("raw")).withColumn("s", parse_synthesis("raw"))
    path = F.concat(F.lit("_synthesis/_synth_"), X.short_hash(F.array_join("sources", ",")), F.lit(".txt"))
    return said.select(path.alias("path"), F.lit("synthesis").alias("kind"), F.col("s.body").alias("body"), "sources", "source_hashes", F.array_intersect("sources", "s.contradicts").alias("contradicts"))


def cluster_edges(nodes: DataFrame) -> DataFrame:
    """(source, target, etype, metadata): ``synthesizes`` to each member, ``contradicts`` to those that the synthesis names."""
    against = nodes.select("path", F.col("contradicts").alias("sources"))
    return derived_edges(nodes, "cluster", "synthesizes").unionByName(derived_edges(against, "cluster", "contradicts"))
