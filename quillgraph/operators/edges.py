"""Cleaning of the edge log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge types that lead from a node to what it came from (fixed values).
PROVENANCE = ("chunked_from", "derived_via", "derived_from", "synthesizes")
#: Edge types along which a search result is widened (fixed values).
EXPANSION = ("related_to", "references", "derived_from")


def has_text(c: Column | str) -> Column:
    """Neither null nor blank; blanks are Unicode white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def edge_type(c: Column | str) -> Column:
    """One spelling of a type: lower case, no outer blanks, ``_`` for each inner hyphen or blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-\s\p{Z}]", "_")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Valid edges with ``etype`` in one spelling.

    Valid: source, target and etype neither null nor blank, source not starting with ``#``.
    Other columns stay; repeated edges stay (they have their own ``seq``).
    """
    ok = has_text("source") & has_text("target") & has_text("etype") & ~F.col("source").startswith("#")
    return edges.where(ok).withColumn("etype", edge_type("etype"))
