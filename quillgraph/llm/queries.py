"""Queries of this subpackage: name to function of (session, table folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from . import mixing, neighbors, packing, split, subjects
from .sizes import byt5_size


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _size():
    return byt5_size(F.col("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    c = config.read(spark, d)
    return neighbors.similar_pairs(_table(spark, d, "chunk_vectors"), int(c["embedding.dimensions"]), float(c["edges.relate_threshold"]))


def p3_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest others of every usable vector, found by 16-bit vectors (whose cosines, off by some millionths, are left out)."""
    return neighbors.nearest(_table(spark, d, "chunk_vectors"), int(config.read(spark, d)["embedding.dimensions"]), exact=False).select("vec_id", "neighbor")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the searches have at least 95% of what brute force finds for every vector whose id is divisible by 50."""
    c = config.read(spark, d)
    v, dims, floor = _table(spark, d, "chunk_vectors"), int(c["embedding.dimensions"]), float(c["edges.relate_threshold"])
    all_ = neighbors.recall(neighbors.nearest(v, dims, exact=False), v, dims).withColumn("search", F.lit("nearest"))
    near = neighbors.recall(neighbors.nearest(v, dims, min_cosine=floor, exact=False), v, dims, min_cosine=floor).withColumn("search", F.lit("threshold"))
    return all_.unionByName(near).select("search", "queries", "wanted", (F.col("hits") >= 0.95 * F.col("wanted")).alias("reached"))


def _pieces(spark: SparkSession, d: str, with_content: bool) -> DataFrame:
    c = config.read(spark, d)
    return split.split_sources(_table(spark, d, "sources"), int(c["general.chunk_size"]), int(c["general.chunk_overlap"]), with_content=with_content)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where(F.col("cut_kind") == "section").select("path", "cut_at").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces must keep, by source: put together they are the source, none is over the size, neighbours share the overlap."""
    c = config.read(spark, d)
    return split.split_check(_pieces(spark, d, True), int(c["general.chunk_size"]), int(c["general.chunk_overlap"]))


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity = int(config.read(spark, d)["llm.max_context"])
    return packing.pack_documents(_table(spark, d, "documents"), capacity, _size()), capacity


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the packing has in more than one window."""
    return _windows(spark, d)[0].where(F.col("piece") > 0).select("doc_id").distinct()


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)[0]


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(*_windows(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What the packing must keep, in one row."""
    return packing.packing_check(*_windows(spark, d))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(_table(spark, d, "documents"), _table(spark, d, "source_weights"), _size())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that stay below their budget in the mix itself."""
    return mixing.short_sources(*_mixture(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(*_mixture(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What the mix must keep, by source."""
    return mixing.mixture_check(*_mixture(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_table(spark, d, "documents"), _table(spark, d, "doc_labels"), _table(spark, d, "subjects"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p8_found(spark, d), _table(spark, d, "documents"), _size())


def p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents with text, and whether at least 85% of them come out with a subject that a reader gave them."""
    names = subjects.subject_names(_table(spark, d, "subjects"))
    said = _table(spark, d, "doc_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names)).distinct()
    said = said.join(_table(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("doc_id"), "doc_id", "left_semi")
    agreed = said.join(p8_found(spark, d), ["doc_id", "subject"], "left_semi").agg(F.count_distinct("doc_id").alias("agreed"))
    return said.agg(F.count_distinct("doc_id").alias("documents")).join(F.broadcast(agreed)).select("documents", (F.col("agreed") >= 0.85 * F.col("documents")).alias("reached"))  # one row each


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_neighbors, p3_recall, p5_found, p5_pieces, p5_check, p6_found, p6_windows, p6_fill, p6_check, p7_found, p7_mix, p7_shares, p7_check, p8_found, p8_composition, p8_agreement,
    )
}
