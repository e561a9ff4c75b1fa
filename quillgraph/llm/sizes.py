"""Size of texts in tokens of a public byte tokenizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byt5_size(text: Column) -> Column:
    """Tokens of the ByT5 tokenizer: one per UTF-8 byte and an end token; 0 for null or blank text."""
    return F.when(F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False)), F.octet_length(text) + 1).otherwise(0).cast("long")
