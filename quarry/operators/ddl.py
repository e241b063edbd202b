"""Schema changes as new versions of a table, and catalog views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.types import enum_text, field
from quarry.operators.constraints import require_empty, require_key


def _order(columns: list[str], name: str, first: bool, after: str | None) -> list[str]:
    rest = [c for c in columns if c != name]
    at = 0 if first else rest.index(after) + 1 if after else len(rest)
    return [*rest[:at], name, *rest[at:]]


def add_column(df: DataFrame, name: str, kind: str, default: str | None = None, first: bool = False, after: str | None = None) -> DataFrame:
    """A new column with a declared type; existing rows get the default, or NULL."""
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"column {name} exists")
    f = field(name, kind)
    value = F.lit(None) if default is None else F.expr(default)
    out = df.withColumn(name, value.cast(f.dataType).alias(name, metadata=f.metadata))
    return out.select(*_order(df.columns + [name], name, first, after))


def modify_column(df: DataFrame, name: str, kind: str, to: str | None = None, first: bool = False, after: str | None = None, enum: list[str] | None = None) -> DataFrame:
    """A new type, name or place. Values that the type can't hold are an error; ``enum``: the value list
    of an ENUM that becomes text."""
    f = field(to or name, kind)
    old = enum_text(enum, name) if enum else F.col(name)
    new = old.try_cast(f.dataType)
    require_empty(df.where(F.col(name).isNotNull() & new.isNull()).select(name), f"out of range for {kind}")
    out = df.withColumn(name, new)
    place = _order(df.columns, name, first, after) if first or after else df.columns
    return out.select(*[F.col(c).alias(f.name, metadata=f.metadata) if c == name else F.col(c) for c in place])


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns or len(df.columns) == 1:
        raise ValueError(f"can't drop {name}")
    return df.drop(name)


def add_primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself once no key is NULL or double."""
    require_key(df, columns)
    return df


def with_generated(df: DataFrame, name: str, expression: str, kind: str) -> DataFrame:
    """A generated column from an SQL expression over the others."""
    return df.withColumn(name, F.expr(expression).cast(field(name, kind).dataType))


def fill_default(df: DataFrame, name: str, expression: str) -> DataFrame:
    """NULLs of a column from its default expression."""
    return df.withColumn(name, F.coalesce(F.col(name), F.expr(expression).cast(df.schema[name].dataType)))


def information_schema_columns(spark: SparkSession, tables: dict[str, DataFrame], database: str = "app") -> DataFrame:
    """table_schema, table_name, column_name, ordinal_position, data_type, is_nullable of frames."""
    rows = [(database, t, f.name, i + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def show_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(names)], "table_name string")


def show_create(name: str, df: DataFrame) -> str:
    own = ", ".join(f"`{f.name}` {(f.metadata or {}).get('mysql_type', f.dataType.simpleString())}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"CREATE TABLE `{name}` ({own})"
