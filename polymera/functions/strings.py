"""String functions whose rules differ from Spark's own: byte lengths, clamped starts, empty for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(s: Column) -> Column:
    """UTF-8 bytes; char_length and character_length mean the same."""
    return F.octet_length(s)


def trim(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def substring(s: Column, start: int, size: int | None = None) -> Column:
    """Characters from a 1-based start; starts before the first mean the first."""
    first = F.lit(max(start, 1))
    return F.substr(s, first) if size is None else F.substr(s, first, F.lit(size))


def concat(*parts: Column) -> Column:
    """Joined parts; a null is the empty string."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def chunk_text(s: Column, size: int, overlap: int = 0) -> Column:
    """Array of (no, start, chunk): pieces of `size` characters, each sharing `overlap` with the one before.

    The last piece reaches the end; null gives null and an empty text an empty array.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    n = F.when(F.char_length(s) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((F.char_length(s) - overlap) / step).cast("int")))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("no"), (i * step + 1).alias("start"), F.substr(s, i * step + 1, F.lit(size)).alias("chunk")))
