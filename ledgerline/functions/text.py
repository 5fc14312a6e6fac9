"""String predicates with Java `String` semantics, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# `Character.isWhitespace` in Java regex terms. NBSP is not whitespace there.
JAVA_BLANK_RE = r"^\p{javaWhitespace}*\z"
# `String.trim`: strips every char <= U+0020 at both ends.
JAVA_TRIM_RE = r"^[\x00-\x20]+|[\x00-\x20]+\z"


def is_blank(c: Column) -> Column:
    """`String.isBlank()`: empty or only Unicode whitespace (null-safe: null -> null).

    Fast path: a first char in printable ASCII (U+0021..U+007E) is never
    whitespace, so the regex only runs on the rare other strings."""
    first = F.substring(c, 1, 1)
    return F.when((first >= F.lit("!")) & (first <= F.lit("~")), F.lit(False)).otherwise(c.rlike(JAVA_BLANK_RE))


def utf16_length(c: Column) -> Column:
    """`String.length()`: UTF-16 code units (a supplementary char counts 2)."""
    n = F.length(c)
    # ASCII-only text (bytes == code points) is 1 unit per char: skip re-encoding
    return F.when(F.octet_length(c) == n, n).otherwise(
        (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def utf16_longer_than(c: Column, limit: int) -> Column:
    """`length() > limit` in UTF-16 units; skips the re-encode when the
    code-point length already decides it (every code point is 1 or 2 units)."""
    n = F.length(c)
    return (F.when(n > limit, F.lit(True))
            .when(n * 2 <= limit, F.lit(False))
            .otherwise(F.octet_length(F.encode(c, "UTF-16BE")) > 2 * limit))


def java_trim(c: Column) -> Column:
    """`String.trim()`."""
    return F.regexp_replace(c, JAVA_TRIM_RE, "")


def sql_btrim_blank(c: Column) -> Column:
    """`BTRIM(x) = ''` — spaces only, weaker than `is_blank`."""
    return F.trim(c) == F.lit("")
