"""A global row number without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.scan import order
from quarry.sources.staging import staged


FEW = 10_000


def global_rank(df: DataFrame, *keys: str, name: str = "rn") -> DataFrame:
    """``df`` with a gapless number from 1 in the order of ``keys`` (which should identify a row).

    Rows are dealt out by ranges of the keys and sorted there; the number is the place within the
    partition plus the rows of all partitions before, of which there are only as many as partitions. Up to
    ``FEW`` rows are numbered in one task instead, which gives the same.
    """
    by = order(*keys)
    if df.limit(FEW + 1).count() <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long"))
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_q_part", F.spark_partition_id()).withColumn("_q_at", local)
    rows = staged(rows, "ranked")
    sizes = rows.groupBy("_q_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(F.broadcast(sizes.select("_q_part", before.alias("_q_before"))), "_q_part")  # a row for each partition
    return out.withColumn(name, F.col("_q_before") + F.col("_q_at") + 1).drop("_q_part", "_q_at", "_q_before")
