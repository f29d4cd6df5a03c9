"""Helpers that several operators of this folder share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.session import materialize

ASCII_UPPER = string.ascii_uppercase
ASCII_LOWER = string.ascii_lowercase

__all__ = ["ascii_lower", "bucket_of", "fresh", "materialize", "text_or_empty", "uniform_of"]


def text_or_empty(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text of ASCII bytes alone takes Spark's fast path; ``lower`` and the
    translation agree there, and only there.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def bucket_of(id_column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def uniform_of(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
