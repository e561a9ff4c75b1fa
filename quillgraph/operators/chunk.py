"""Chunking of documents by strategy."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

STRATEGIES = ("heading", "paragraph", "function", "fixed", "proposition")
#: Words that open a function or class, on a line without its indentation (fixed values).
OPENERS = ("def ", "class ", "function ", "const ", "let ", "var ", "export ", "pub fn ", "fn ", "func ")
#: Shortest sentence that is a proposition, in characters (fixed value).
PROPOSITION_OVER = 10


class _Fold:
    """Lines gathered into chunks; a new chunk begins with the tail of the one before."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.held: list[str] = []
        self.length = 0
        self.out: list[tuple[str, str]] = []
        self.heading = ""

    def cut(self, *more: str) -> None:
        """Emit what is held and go on with its tail and ``more``; blank chunks vanish."""
        chunk = "\n".join(self.held)
        self.emit(chunk)
        self.held = [*([chunk[-self.overlap :]] if self.overlap > 0 else []), *more]
        self.length = sum(map(len, self.held))  # without line ends, unlike added lines

    def emit(self, chunk: str) -> None:
        if chunk.strip():
            self.out.append((chunk, self.heading))

    def add(self, line: str) -> None:
        self.held.append(line)
        self.length += len(line) + 1
        if self.length >= self.size:
            self.cut()

    def finish(self) -> list[tuple[str, str]]:
        if self.held:
            self.emit("\n".join(self.held))
        return self.out


def by_heading(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """(chunk, heading in force before its end); every line that starts with # begins a chunk."""
    fold = _Fold(size, overlap)
    for line in text.split("\n"):
        if not line.startswith("#"):
            fold.add(line)
            continue
        if fold.length > 0:
            fold.cut(line)
        elif not fold.held:
            fold.held, fold.length = [line], len(line) + 1
        fold.heading = line.strip()
    return fold.finish()


def by_function(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """Chunks that begin where a line opens a function or class."""
    fold = _Fold(size, overlap)
    for line in text.split("\n"):
        if fold.length > 0 and line.lstrip().startswith(OPENERS):
            fold.cut(line)
        else:
            fold.add(line)
    return fold.finish()


def by_paragraph(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """Paragraphs packed up to the size; none is split."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not part:
            continue
        if not held:
            held = part
        elif len(held) + len(part) + 2 > size:
            out.append(held)
            held = f"{held[-overlap:]}\n\n{part}" if overlap > 0 else part
        else:
            held = f"{held}\n\n{part}"
    return [(c, "") for c in [*out, *([held] if held.strip() else [])]]


def by_window(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """Windows of ``size`` characters that overlap; blank ones vanish."""
    step = size - (min(overlap, size - 1) if size > 1 else 0)
    n = 1 if len(text) <= size else 1 + -(-(len(text) - size) // step)
    cut = [text[i * step : i * step + size] for i in range(n)]
    return [(c, "") for c in cut if c.strip()]


def propositions(text: str) -> list[str]:
    """Sentences of more than 10 characters; the whole text if there are none."""
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip())]
    return [s for s in found if len(s) > PROPOSITION_OVER] or [text]


def by_proposition(text: str, size: int, overlap: int, decompose=None) -> list[tuple[str, str]]:
    """Heading chunks taken apart into propositions, by ``decompose`` (text to lines) or by sentences."""
    out = []
    for chunk, heading in by_heading(text, size, overlap):
        lines = [x.strip() for x in (decompose(chunk) or "").splitlines() if len(x.strip()) > PROPOSITION_OVER] if decompose else []
        out += [(p, heading) for p in lines or propositions(chunk)]
    return out


_BY = {"heading": by_heading, "paragraph": by_paragraph, "function": by_function, "fixed": by_window, "proposition": by_proposition}


def chunk_text(text: str, strategy: str, size: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """(chunk, heading) of a text; an unknown strategy is 'fixed', a text without a chunk is one chunk."""
    return _BY.get(strategy, by_window)(text, size, overlap) or [(text, "")]


def strategy_for(file_type: Column, configured: str = "heading") -> Column:
    """Strategy by file type; 'proposition' overrides."""
    if configured == "proposition":
        return F.lit(configured)
    by_type = F.when(file_type == "markdown", "heading").when(file_type == "code", "function").when(file_type == "text", "paragraph")
    return by_type.otherwise(configured)


_CHUNKS = T.ArrayType(T.StructType([T.StructField("body", T.StringType()), T.StructField("heading", T.StringType())]))


def chunk_documents(documents: DataFrame, size: int = 1000, overlap: int = 100, *, text: str = "text", strategy: str = "strategy") -> DataFrame:
    """Documents exploded into chunks: their columns without the text, and position, total, body, heading.

    Null texts count as empty; an empty text is one empty chunk.
    """

    @F.pandas_udf(_CHUNKS)
    def cut(texts: pd.Series, strategies: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t, s, size, overlap) for t, s in zip(texts, strategies)])

    rest = [c for c in documents.columns if c != text]
    made = documents.select(*rest, cut(F.coalesce(text, F.lit("")), F.coalesce(F.col(strategy), F.lit("fixed"))).alias("_c"))
    rows = made.select(*rest, F.size("_c").alias("total"), F.posexplode("_c").alias("_p", "_x"))
    return rows.select(*rest, (F.col("_p") + 1).alias("position"), "total", F.col("_x.body").alias("body"), F.col("_x.heading").alias("heading"))


def windows(documents: DataFrame, size: int = 1000, overlap: int = 100, *, text: str = "text") -> DataFrame:
    """The fixed strategy in SQL expressions: document columns without the text, and position, body."""
    step = size - (min(overlap, size - 1) if size > 1 else 0)
    n = F.char_length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
    rest = [c for c in documents.columns if c != text]
    cut = documents.where(n > 0).select(*rest, text, F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    rows = cut.select(*rest, (F.col("_i") + 1).alias("position"), F.substring(F.col(text), F.col("_i") * step + 1, F.lit(size)).alias("body"))
    return rows.where(X.has_body("body"))


def sentences(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """The proposition fallback in SQL expressions: document columns without the text, and position, body."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(trimmed, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.char_length(s) > PROPOSITION_OVER)
    rest = [c for c in documents.columns if c != text]
    rows = documents.where(F.col(text).isNotNull()).select(*rest, F.when(F.size(parts) == 0, F.array(F.col(text))).otherwise(parts).alias("_s"))
    return rows.select(*rest, F.posexplode("_s").alias("_p", "body")).select(*rest, (F.col("_p") + 1).alias("position"), "body")


def chunk_path(domain: Column, document: Column, position: Column) -> Column:
    """[domain/]document/NN.txt."""
    n = position.cast("string")
    return F.concat(F.when(F.coalesce(domain, F.lit("")) == "", "").otherwise(F.concat(domain, F.lit("/"))), document, F.lit("/"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n), F.lit(".txt"))
