"""Point, range and multi-range scans over key columns, as predicates that reach the file scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Span:
    """Values of one column between two bounds; None is open. ``null`` selects NULL instead."""

    low: object = None
    high: object = None
    low_closed: bool = True
    high_closed: bool = False
    null: bool = False

    def empty(self) -> bool:
        if self.null or self.low is None or self.high is None:
            return False
        return self.low > self.high or (self.low == self.high and not (self.low_closed and self.high_closed))

    def predicate(self, column: str) -> Column:
        c = F.col(column)
        if self.null:
            return c.isNull()
        parts = []
        if self.low is not None:
            parts.append(c >= self.low if self.low_closed else c > self.low)
        if self.high is not None:
            parts.append(c <= self.high if self.high_closed else c < self.high)
        return reduce(Column.__and__, parts) if parts else c.isNotNull()


def point(value) -> Span:
    return Span(null=True) if value is None else Span(value, value, True, True)


def get(df: DataFrame, **key) -> DataFrame:
    """Rows with all the given values (None: NULL)."""
    return df.where(reduce(Column.__and__, [point(v).predicate(k) for k, v in key.items()]))


def scan(df: DataFrame, spans: dict[str, Span | list[Span]], where: Column | None = None) -> DataFrame:
    """Rows within the span of every column; a list of spans of a column is their union, in one scan.

    A contradiction is found before anything is read: the optimizer doesn't fold ``x > 5 and x < 3``.
    ``where`` is the residual filter; only true passes.
    """
    parts = []
    for column, given in spans.items():
        own = [s for s in (given if isinstance(given, list) else [given]) if not s.empty()]
        if not own:
            return df.limit(0)
        parts.append(reduce(Column.__or__, [s.predicate(column) for s in own]))
    if where is not None:
        parts.append(where)
    return df.where(reduce(Column.__and__, parts)) if parts else df


def ordered(df: DataFrame, *keys: str, reverse: bool = False) -> DataFrame:
    """Sorted by mixed-direction keys ("a", "-b"); NULLs first ascending and last descending."""
    return df.orderBy(*order(*keys, reverse=reverse))


def order(*keys: str, reverse: bool = False) -> list[Column]:
    out = []
    for k in keys:
        down = k.startswith("-") != reverse
        c = F.col(k.lstrip("-"))
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


def latest(df: DataFrame, by: str, *keys: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows of each ``by`` in the order of the keys, with their rank ``rn``."""
    w = Window.partitionBy(by).orderBy(*order(*keys))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def matching(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All of the conditions that are given; none: every row."""
    own = [c for c in conditions if c is not None]
    return df.where(reduce(Column.__and__, own)) if own else df


def contains_text(column: str, needle: str, fold: bool = False) -> Column:
    """LIKE '%needle%' with the wildcards and the escape character of the needle taken literally."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%") if fold else F.col(column).like(f"%{escaped}%")


def rows_equal(a: str, b: str, columns: list[str]) -> Column:
    """NULL-safe equality of all columns of two aliased frames."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])
