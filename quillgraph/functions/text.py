"""Text expressions as Columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and what deletes from a token, alike in Java, RE2 and Python.
SPACE, NOT_WORD = r"[\s\p{Z}\x1c-\x1f\x85]+", r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Index tokens: lower case, punctuation deleted, split at white space, of two characters or more."""
    words = F.split(F.regexp_replace(F.lower(col(text)), NOT_WORD, ""), SPACE)
    return F.filter(words, lambda w: F.char_length(w) >= 2)


def query_words(text: Column | str) -> Column:
    """Words of a scan query: lower case, split at white space, punctuation kept, of two characters or more."""
    return F.filter(F.split(F.lower(col(text)), SPACE), lambda w: F.char_length(w) >= 2)


def substring_count(text: Column | str, part: Column | str) -> Column:
    """How often ``part`` lies in ``text`` without overlap."""
    t, p = col(text), col(part)
    return ((F.char_length(t) - F.char_length(F.replace(t, p, F.lit("")))) / F.char_length(p)).cast("int")


def has_body(text: Column | str) -> Column:
    """Text that is neither null nor blank."""
    return F.coalesce(col(text).rlike(r"[^\s\p{Z}]"), F.lit(False))


def sanitize(name: Column | str) -> Column:
    """A name in lower case with only a-z, 0-9, dot, underscore and hyphen; 'document' if nothing is left."""
    clean = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9._-]", "")
    return F.when(clean == "", "document").otherwise(clean)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), SPACE), lambda w: w != ""))


def token_estimate(text: Column | str) -> Column:
    """Estimated tokens: 1.3 a word, cut to a whole number."""
    return (word_count(text) * F.lit(1.3)).cast("int")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def domain_of(path: Column | str) -> Column:
    """The first segment of a path of three or more segments, else ''."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) >= 3, parts[0]).otherwise("")


def document_of(path: Column | str) -> Column:
    """The first two segments of a path."""
    return F.array_join(F.slice(F.split(col(path), "/"), 1, 2), "/")


def is_synthesis(path: Column | str) -> Column:
    return file_name(path).startswith("_")


def is_numbered(path: Column | str) -> Column:
    return file_name(path).rlike("^[0-9]")


def is_hidden(path: Column | str) -> Column:
    return file_name(path).startswith(".")


def preview(body: Column | str) -> Column:
    """The first two lines, at most 120 characters."""
    return F.substring(F.array_join(F.slice(F.split(col(body), "\n"), 1, 2), " "), 1, 120)


def content_hash(text: Column | str) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 16)


def short_hash(text: Column | str) -> Column:
    """The first 8 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 8)


def valid_text(content: Column | str) -> Column:
    """Bytes as text; invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(col(content).cast("string"))
