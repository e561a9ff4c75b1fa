"""Files of a store: source scans, edge logs, domain rules, the ledger, packed vectors."""

from __future__ import annotations

import hashlib
import struct
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Head of a packed vector file: magic, version, width, count, model hash, 12 bytes (fixed values).
MAGIC, VERSION, HEAD = 0x52414744, 1, 32


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modified) of the files below ``path``, without hidden ones and those in store and git folders.

    Spark's file source leaves out files without a byte; they are added from its own list of files.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = [(unquote(f),) for f in rows.inputFiles()]  # the list that the driver has made to plan the scan
    same = lambda c: F.regexp_replace(c, r"^file:/*", "file:/")
    empty = spark.createDataFrame(listed, "path string").withColumn("path", same("path")).join(rows.where(F.col("length") > 0).select(same("path").alias("path")), "path", "left_anti")
    rows = rows.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    clean = F.regexp_replace("path", r"^file:/*", "/")
    below = F.substring(clean, len(path.rstrip("/")) + 1, 1_000_000)
    hidden = below.rlike(r"(^|/)\.[^/]*$") | below.rlike(r"(^|/)\.(quillgraph|git)/")
    return rows.select(clean.alias("path"), "content", "length", F.col("modificationTime").alias("modified"), hidden.alias("_h")).where(~F.col("_h")).drop("_h")


def read_edge_log(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, etype, metadata) of a tab-separated edge log; comments, blank and short lines are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(parts) >= 3))
    return rows.select(parts[0].alias("source"), parts[1].alias("target"), parts[2].alias("etype"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("metadata"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of an edge log that have too few fields."""
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(F.split("value", "\t")) < 3))


def parse_rules(text: str) -> list[tuple[int, str, str]]:
    """(order, pattern, domain) of domain rules 'patterns -> domain' (or with an arrow), one rule a line, patterns split at blanks."""
    out = []
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        for arrow in ("\u2192", "->"):
            if line and not line.startswith("#") and arrow in line:
                patterns, _, domain = line.partition(arrow)
                out += [(n, p.lower(), domain.strip()) for p in patterns.split()]
                break
    return out


def apply_rules(paths: DataFrame, rules: DataFrame, default: str = "unsorted", path: str = "path") -> DataFrame:
    """``paths`` with ``domain``: the first rule (ord, pattern, domain) whose pattern lies in the path in lower case.

    The rules are a list that a user writes; they are folded into one expression.
    """
    listed = sorted(rules.select("ord", "pattern", "domain").collect(), key=lambda r: r.ord)
    found: Column = F.lit(default)
    for r in reversed(listed):
        found = F.when(F.lower(path).contains(r.pattern.lower()), r.domain).otherwise(found)
    return paths.withColumn("domain", found)


def unprocessed(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources (path, content_hash) that the ledger (source_path, content_hash) does not hold exactly."""
    known = ledger.select(F.col("source_path").alias("path"), "content_hash").distinct()
    return sources.join(known, ["path", "content_hash"], "left_anti")


def upsert_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the rows of ``new`` in place of those of the same path; the last of repeated paths counts."""
    w = Window.partitionBy("source_path").orderBy(F.desc("processed_at"), F.desc("content_hash"))
    last = new.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return ledger.join(last.select("source_path"), "source_path", "left_anti").unionByName(last)


def model_hash(name: str) -> int:
    """The first four bytes of the name's SHA-256 as a number in native order."""
    return struct.unpack("=I", hashlib.sha256(name.encode()).digest()[:4])[0]


def pack_vectors(vectors: np.ndarray, model: str) -> bytes:
    """A packed vector file."""
    v = np.ascontiguousarray(vectors, np.float32)
    return struct.pack("=IIIII12x", MAGIC, VERSION, v.shape[1], v.shape[0], model_hash(model)) + v.tobytes()


def unpack_vectors(raw: bytes) -> np.ndarray:
    """The vectors of a packed file; ValueError if it is none or cut off."""
    magic, version, dims, count, _ = struct.unpack_from("=IIIII", raw)
    if magic != MAGIC or version != VERSION or len(raw) < HEAD + 4 * dims * count:
        raise ValueError("not a whole vector file")
    return np.frombuffer(raw, np.float32, dims * count, HEAD).reshape(count, dims)


def parse_manifest(text: str) -> list[tuple[str, int, str]]:
    """(path, index, content_hash) of a manifest; lines of four columns have no hash."""
    rows = (line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#"))
    return [(r[0], int(r[1]), r[4] if len(r) > 4 else "") for r in rows if len(r) >= 4]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, domain, vec, dims, content_hash) of the packed files (embeddings.bin beside manifest.tsv) below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bin,tsv}").load(path)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    of = files.groupBy(folder.alias("folder")).agg(
        F.max(F.when(F.col("path").endswith(".bin"), F.col("content"))).alias("raw"), F.max(F.when(F.col("path").endswith(".tsv"), F.col("content"))).alias("manifest")
    )
    entry = T.StructType([T.StructField("path", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("content_hash", T.StringType())])

    @F.pandas_udf(T.ArrayType(entry))
    def rows(raw: pd.Series, manifest: pd.Series) -> pd.Series:
        out = []
        for r, m in zip(raw, manifest):
            v = unpack_vectors(bytes(r))
            out.append([{"path": p, "vec": v[i], "content_hash": h} for p, i, h in parse_manifest(bytes(m).decode()) if i < len(v)])
        return pd.Series(out)

    whole = of.where(F.col("raw").isNotNull() & F.col("manifest").isNotNull())
    return whole.select(F.element_at(F.split("folder", "/"), -1).alias("domain"), F.explode(rows("raw", "manifest")).alias("r")).select("r.path", "domain", "r.vec", F.size("r.vec").alias("dims"), "r.content_hash")


def find_store(start: str, name: str = ".quillgraph") -> str | None:
    """The nearest folder above ``start`` that holds a store."""
    at = Path(start).resolve()
    return next((str(p / name) for p in (at, *at.parents) if (p / name).is_dir()), None)
