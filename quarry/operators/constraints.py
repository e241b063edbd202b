"""Constraints as queries for the rows that break them; an empty result means they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import folded, prefix


class ConstraintError(ValueError):
    pass


def duplicates(df: DataFrame, columns: list[str], collation: str | None = None, prefixes: dict[str, int] | None = None) -> DataFrame:
    """Values of a unique key held by more than one row, and ``n``; rows with a NULL in it are exempt.

    Under a collation, spellings of equal weight are one value. ``prefixes``: how many first bytes of a
    column belong to the key.
    """
    own = [k.alias(f"_key_{c}") for c, k in zip(columns, unique_key(df, columns, collation, prefixes), strict=True)]
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    firsts = [F.min(c).alias(c) for c in columns]
    return df.where(present).groupBy(*own).agg(*firsts, F.count("*").alias("n")).where("n > 1").select(*columns, "n")


def unique_key(df: DataFrame, columns: list[str], collation: str | None = None, prefixes: dict[str, int] | None = None) -> list[Column]:
    """What a unique key compares of each column."""
    text = lambda c: df.schema[c].dataType.typeName() == "string"
    return [prefix(c, prefixes[c]) if c in (prefixes or {}) else folded(c, collation) if collation and text(c) else F.col(c) for c in columns]


def taken(rows: DataFrame, table: DataFrame, columns: list[str], prefixes: dict[str, int] | None = None) -> DataFrame:
    """Rows whose unique key is one of the table's; a NULL in it exempts the row. The table isn't shuffled while
    the rows are few."""
    keys = [f"_k{i}" for i in range(len(columns))]
    wide = lambda d: d.select("*", *[k.alias(n) for n, k in zip(keys, unique_key(d, columns, None, prefixes), strict=True)])
    return wide(rows).join(wide(table).select(*keys), keys, "left_semi").select(*rows.columns)


def require_valid(rows: DataFrame, table: DataFrame, meta: dict) -> None:
    """New rows of a table against its CHECK, UNIQUE and unique index definitions; ``table``: the rows that stay
    beside them. Only the new rows are checked."""
    for c in meta.get("checks", []):
        require_empty(check_failures(rows, c), f"check {c}")
    for columns, prefixes in [*((u, None) for u in meta.get("unique", [])), *((i["columns"], i.get("prefixes")) for i in meta.get("indexes", {}).values() if i["unique"])]:
        require_empty(duplicates(rows, columns, prefixes=prefixes), f"unique {columns}")
        require_empty(taken(rows, table, columns, prefixes).select(*columns), f"unique {columns}")


def null_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


def check_failures(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a CHECK is false; NULL passes."""
    e = F.expr(expression)
    return df.where(e.isNotNull() & ~e)


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of the child without their parent; a NULL in the foreign key exempts the row."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    on = reduce(Column.__and__, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)])
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return child.where(present).join(keys, on, "left_anti")


def require_empty(rows: DataFrame, what: str) -> None:
    found = rows.limit(3).collect()
    if found:
        raise ConstraintError(f"{what}: {[r.asDict() for r in found]}")


def require_key(df: DataFrame, columns: list[str], what: str = "primary key") -> None:
    require_empty(null_keys(df, columns).select(*columns), f"{what} has NULL")
    require_empty(duplicates(df, columns), f"{what} has duplicates")
