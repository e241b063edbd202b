"""Table statistics: rows, distinct values, nulls, average width and a histogram in key order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rank import global_rank


def _joined(columns: list[str]) -> Column:
    """The tuple as text: NULL as '', joined by a blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def analyze(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct_rows (of the tuple as text, so NULL and '' are one), null_rows (any NULL)
    and avg_size (printed width of all columns)."""
    some_null = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    width = sum((F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(_joined(columns)).alias("distinct_rows"), F.coalesce(F.sum(some_null), F.lit(0)).alias("null_rows"), F.round(F.avg(width), 4).alias("avg_size"))


def histogram(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """bucket, n and bound: buckets of ``max(1, rows div 16)`` rows in key order; the bound is the tuple of
    the last row of the bucket. The last bucket may be short, so there may be more than 16."""
    ranked = global_rank(df.select(*dict.fromkeys([*columns, *key])), *key)
    n = df.count()
    step = max(1, n // 16)
    rows = ranked.select(F.floor((F.col("rn") - 1) / step).cast("long").alias("bucket"), "rn", _joined(columns).alias("t"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max_by("t", "rn").alias("bound"))


def to_json(row) -> str:
    """A row of :func:`analyze` for keeping beside a table's metadata."""
    return json.dumps(row.asDict(), sort_keys=True)
