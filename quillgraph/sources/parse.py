"""Parsers: source texts to plain text, as expressions where SQL can do it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: File types by extension (fixed values).
TYPES = {
    "markdown": ("md", "markdown"),
    "text": ("txt", "text", "log"),
    "code": ("py", "js", "ts", "go", "rs", "java", "c", "cpp", "h", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "r", "jl", "lua", "pl", "hpp", "ex", "exs", "clj", "hs", "ml"),
    "csv": ("csv", "tsv"),
    "json": ("json", "jsonl"),
    "pdf": ("pdf",),
    "html": ("html", "htm"),
    "docx": ("docx",),
    "config": ("yaml", "yml", "toml", "ini", "cfg", "conf"),
}
#: More types than the fixed ones.
MORE = {"markdown": ("mdx", "rst"), "code": ("jsx", "tsx", "sql")}


def detect_type(path: Column | str) -> Column:
    """The file type that the extension tells; 'text' for an unknown one."""
    ext = F.lower(F.regexp_extract(X.col(path), r"\.([^./]+)$", 1))
    entries = [F.lit(v) for name, exts in (*TYPES.items(), *MORE.items()) for e in exts for v in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*entries), ext), F.lit("text"))


def strip_front_matter(text: Column | str) -> Column:
    """Markdown without the block from a leading --- to the next ---, wherever that is."""
    t = X.col(text)
    close = F.locate("---", t, 4)
    rest = F.regexp_replace(F.substring(t, close + 3, F.char_length(t)), r"^\n+", "")
    return F.when(t.startswith("---") & (close > 0), rest).otherwise(t)


#: Front matter of a stored node: the block from the first line --- to the next line ---.
_NODE = r"(?s)^---\n(.*?)\n---\n(.*)$"


def node_front(raw: Column | str) -> Column:
    return F.regexp_extract(X.col(raw), _NODE, 1)


def node_body(raw: Column | str) -> Column:
    """The text behind the front matter; all of it if there is none."""
    r = X.col(raw)
    return F.when(r.rlike(_NODE), F.regexp_extract(r, _NODE, 2)).otherwise(r)


def node_value(raw: Column | str, key: str) -> Column:
    """A value of the front matter as text, null if the key is not there."""
    m = F.regexp_extract(node_front(raw), rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.when(node_front(raw).rlike(rf"(?m)^{key}:"), F.trim(m))


def read_node(nodes: DataFrame, raw: str = "content") -> DataFrame:
    """Nodes with type, sources, source_hashes, stale and body; type is null for texts that are no nodes."""
    names = lambda k: F.coalesce(F.from_json(node_value(raw, k), "array<string>"), F.array().cast("array<string>"))
    kind = node_value(raw, "type")
    return nodes.select(
        "*", kind.alias("type"), names("sources").alias("sources"), names("source_hashes").alias("source_hashes"),
        F.coalesce(node_value(raw, "stale") == "true", F.lit(False)).alias("stale"), node_body(raw).alias("body"),
    )


def write_node(kind: Column, body: Column, sources: Column, hashes: Column, generated: Column, stale: Column) -> Column:
    """A synthesis node as text with front matter."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    flag = F.when(stale, "true").otherwise("false")
    return F.concat_ws("\n", F.lit("---"), line("type", kind), line("generated", generated), line("sources", F.to_json(sources)), line("source_hashes", F.to_json(hashes)), line("stale", flag), F.lit("---"), body)


def html_text(html: Column | str) -> Column:
    """HTML without scripts, styles and tags, white space as single blanks; entities stay."""
    t = X.col(html)
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def csv_records(rows: DataFrame, number: Column, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with ``text``: '--- Record n ---' and a 'name: value' line for each value that is not empty."""
    columns = columns or rows.columns
    lines = F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))
    head = F.format_string("--- Record %d ---", number)
    return rows.withColumn("text", F.concat_ws("\n", head, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")))


def csv_text(text: Column | str) -> Column:
    """A whole CSV file as records."""
    return _csv(X.col(text))


@F.pandas_udf(T.StringType())
def _csv(texts: pd.Series) -> pd.Series:
    import csv
    import io

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out = []
        for n, row in enumerate(csv.DictReader(io.StringIO(t)), 1):
            out += [f"--- Record {n} ---", *(f"{k}: {v}" for k, v in row.items() if v and isinstance(v, str))]
        return "\n".join(out)

    return texts.map(one)


def flatten(value: object, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, value as Python writes it) of the leaves of a JSON value, in order, without recursion."""
    out, stack = [], [(prefix, value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict | list):
            items = v.items() if isinstance(v, dict) else enumerate(v)
            stack += [(f"{path}.{k}" if path else str(k), x) for k, x in reversed(list(items))]
        else:
            out.append((path, str(v)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def json_leaves(texts: pd.Series) -> pd.Series:
    """The leaves of JSON texts in order; null for what is not JSON."""

    def one(t: str | None) -> list | None:
        try:
            return flatten(json.loads(t)) if t is not None else None
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def json_text(text: Column | str) -> Column:
    """JSON as 'path: value' lines; text that is not one JSON value stays as it is."""
    t = X.col(text)
    return F.coalesce(F.array_join(F.transform(json_leaves(t), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n"), t)


def parse(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files`` (path, content as bytes) with ``ftype`` and ``text``.

    ``extractors`` turn PDF and DOCX bytes into text; a type without one, or a failing one, leaves
    the bytes as text. Each parser sees only its own type's texts.
    """
    rows = files.withColumn("ftype", detect_type("path")).withColumn("_raw", X.valid_text("content"))
    of = lambda kind: F.when(F.col("ftype") == kind, F.col("_raw"))
    text = (
        F.when(F.col("ftype") == "markdown", strip_front_matter("_raw"))
        .when(F.col("ftype") == "html", html_text("_raw"))
        .when(F.col("ftype") == "csv", csv_text(of("csv")))
        .when(F.col("ftype") == "json", json_text(of("json")))
    )
    for kind, extract in (extractors or {}).items():

        def safe(b: bytes, extract=extract) -> str | None:
            try:
                return extract(bytes(b)) if b is not None else None
            except Exception:  # a broken file keeps its bytes as text
                return None

        text = text.when(F.col("ftype") == kind, F.udf(safe, "string")(F.when(F.col("ftype") == kind, F.col("content"))))
    return rows.withColumn("text", F.coalesce(text, F.col("_raw"))).drop("_raw")
