"""MySQL column types as Spark types, with what Spark can't hold kept as field metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

#: Type names of the dialect without a parameter that matters.
_PLAIN = {
    "bool": T.ByteType(), "boolean": T.ByteType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(),
    "char": T.StringType(), "varchar": T.StringType(), "tinytext": T.StringType(), "text": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "tinyblob": T.BinaryType(), "blob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "time": T.DayTimeIntervalType(), "year": T.ShortType(),
    "json": T.StringType(), "geometry": T.BinaryType(), "point": T.BinaryType(), "set": T.LongType(), "enum": T.IntegerType(),
}
_WIDER = {T.ByteType(): T.ShortType(), T.ShortType(): T.IntegerType(), T.IntegerType(): T.LongType(), T.LongType(): T.DecimalType(20, 0)}


def field(name: str, text: str, nullable: bool = True) -> T.StructField:
    """The Spark field of a column declared as ``text``, e.g. "DECIMAL(10,2)" or "ENUM('a','b')"."""
    m = re.match(r"\s*(\w+)\s*(?:\((.*)\))?\s*(.*)$", text, re.S)
    if not m:
        raise ValueError(f"not a type: {text}")
    kind, inner, rest = m[1].lower(), m[2], m[3].lower()
    meta: dict = {"mysql_type": text.strip()}
    if kind in ("decimal", "numeric"):
        p, s = ([int(x) for x in (inner or "10").split(",")] + [0])[:2]
        if p > 38:
            raise ValueError(f"{text}: at most 38 digits can be held")
        return T.StructField(name, T.DecimalType(p, s), nullable, meta)
    if kind == "vector":
        return T.StructField(name, T.ArrayType(T.FloatType()), nullable, meta)
    if kind not in _PLAIN:
        raise ValueError(f"unknown type {kind}")
    own = _PLAIN[kind]
    if kind in ("enum", "set"):
        meta["values"] = [a.replace("''", "'") for a in re.findall(r"'((?:[^']|'')*)'", inner or "")]
    if "unsigned" in rest:
        own = _WIDER.get(own, own)
    if re.search(r"collate\s+\w+_ci", rest) and isinstance(own, T.StringType):
        own = T.StringType("UTF8_LCASE")
    return T.StructField(name, own, nullable, meta)


def enum_index(values: list[str], text) -> Column:
    """The place of an ENUM value in its list from 1, NULL for another: what ORDER BY sorts by."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at.cast("int"))


def enum_text(values: list[str], index) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index if isinstance(index, Column) else F.col(index))


def set_bits(values: list[str], text) -> Column:
    """The bit mask of a SET value given as comma-separated text."""
    own = F.split(F.col(text) if isinstance(text, str) else text, ",")
    return sum((F.when(F.array_contains(own, v), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(values)), F.lit(0)).cast("long")


def zero_date(text) -> tuple[Column, Column]:
    """A date text that may be 0000-00-00: the date (NULL for it), and whether it was the zero date."""
    c = F.col(text) if isinstance(text, str) else text
    return c.try_cast("date"), F.coalesce(c.startswith("0000-00-00"), F.lit(False))
