"""Store settings: the ``store_config`` table and the INI file of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default settings of a new store (fixed values, but for the two weights, which have an effect here: equal ones are plain rank fusion).
DEFAULTS = {
    "general.chunk_strategy": "heading",
    "general.chunk_size": "1000",
    "general.chunk_overlap": "100",
    "embedding.provider": "none",
    "embedding.model": "text-embedding-3-small",
    "embedding.dimensions": "1536",
    "llm.provider": "none",
    "llm.model": "gpt-4o-mini",
    "llm.max_context": "8000",
    "search.default_mode": "hybrid",
    "search.top_k": "10",
    "search.keyword_weight": "0.5",
    "search.vector_weight": "0.5",
    "search.rerank": "false",
    "search.rerank_model": "cross-encoder/ms-marco-MiniLM-L-6-v2",
    "search.hyde": "false",
    "search.crag": "false",
    "search.crag_max_retries": "1",
    "edges.auto_relate": "false",
    "edges.relate_threshold": "0.8",
    "edges.record_queries": "false",
    "synthesis.enabled": "false",
    "synthesis.on_ingest": "summary,entities",
    "synthesis.on_query": "off",
    "synthesis.on_relate": "clusters",
    "synthesis.synthesis_boost": "1.2",
}


def effective(config: DataFrame) -> DataFrame:
    """(key, value) that count: per key the row of smallest ``ord``; ``#`` keys are comments; blanks cut."""
    key = F.trim("key")
    rows = config.where(key.isNotNull() & (key != "") & ~key.startswith("#"))
    return rows.groupBy(key.alias("key")).agg(F.min_by(F.trim("value"), "ord").alias("value"))


def from_table(config: DataFrame) -> dict[str, str]:
    """The settings as a dictionary (a settings table has some dozens of rows)."""
    return {r.key: r.value or "" for r in effective(config).collect()}


def read(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Settings of the store below ``sf_dir``, over the defaults."""
    return DEFAULTS | {k: v for k, v in from_table(spark.read.parquet(f"{sf_dir}/store_config.parquet")).items() if v}


def parse_ini(text: str) -> dict[str, str]:
    """INI text as ``section.key`` → value: the first match counts, only ``#`` starts a comment."""
    found: dict[str, str] = {}
    section = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            found.setdefault(f"{section}.{k.strip()}" if section else k.strip(), v.strip())
    return found


def set_ini(text: str, key: str, value: str) -> str:
    """INI text with one setting replaced, else put at the end of its section, else in a new section."""
    section, dot, name = key.partition(".")
    if not dot or not section or not name:
        raise ValueError(f"a setting is named section.key, not {key!r}")
    lines = text.splitlines()
    heads = [i for i, x in enumerate(lines) if x.strip() == f"[{section}]"]
    if not heads:
        return "\n".join([*lines, *([""] if lines else []), f"[{section}]", f"{name} = {value}"]) + "\n"
    start = heads[0] + 1
    end = next((i for i in range(start, len(lines)) if lines[i].strip().startswith("[")), len(lines))
    for i in range(start, end):
        if not lines[i].lstrip().startswith("#") and lines[i].partition("=")[0].strip() == name and "=" in lines[i]:
            return "\n".join([*lines[:i], f"{name} = {value}", *lines[i + 1 :]]) + "\n"
    while end > start and not lines[end - 1].strip():
        end -= 1
    return "\n".join([*lines[:end], f"{name} = {value}", *lines[end:]]) + "\n"
