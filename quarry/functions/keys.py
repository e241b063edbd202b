"""Keys whose bytes sort like the values, and other properties of key values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWEST = -(1 << 63)


def encode_int(column) -> Column:
    """Hex text of a tag and the offset-binary value: sorts like the signed integer, NULL first."""
    c = F.col(column) if isinstance(column, str) else column
    flipped = c.cast("long").bitwiseXOR(F.lit(_LOWEST))
    return F.when(c.isNull(), "00").otherwise(F.concat(F.lit("01"), F.lpad(F.hex(flipped), 16, "0")))


def encode_text(column) -> Column:
    """Hex text that sorts like the string's bytes, a prefix first ('a' before 'aa' before 'b')."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), "00").otherwise(F.concat(F.lit("02"), F.hex(c.cast("binary")), F.lit("")))


def prefix(column, n_bytes: int) -> Column:
    """The first bytes of a string: what a prefix index compares."""
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(c.cast("binary"), 1, n_bytes)


def folded(column, collation: str = "UTF8_LCASE") -> Column:
    """The column under a case-insensitive collation, for comparisons and uniqueness."""
    return F.collate(F.col(column) if isinstance(column, str) else column, collation)
