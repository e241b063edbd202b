"""Row changes as new tables: insert, update, delete, replace, upsert, with MySQL's conflict rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.constraints import duplicates, require_empty, require_key
from quarry.operators.rank import global_rank


def _last(rows: DataFrame, keys: list[str], order: str | None, first: bool = False) -> DataFrame:
    """One row a key: the last (or first) by ``order``; without an order any."""
    if order is None:
        return rows.dropDuplicates(keys)
    pick = F.min_by if first else F.max_by
    x = rows.groupBy(*keys).agg(pick(F.struct(*[c for c in rows.columns if c != order]), F.col(order)).alias("_x"))
    return x.select(*[F.col(f"_x.{c}").alias(c) for c in rows.columns if c != order])


def insert(base: DataFrame, rows: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Rows added; a key that exists, or comes twice, is an error."""
    if check:
        require_key(rows, keys)
        require_empty(rows.join(base.select(*keys), keys, "left_semi").select(*keys), "duplicate key")
    return base.unionByName(rows.select(*base.columns))


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows whose key is new are added, the first of each; the others are left out."""
    new = _last(rows, keys, order, first=True).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(new.select(*base.columns))


def replace(base: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows take the place of those of their key, the last of each."""
    new = _last(rows, keys, order)
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, keys: list[str], on_duplicate: dict[str, Column]) -> DataFrame:
    """ON DUPLICATE KEY UPDATE: new keys are added, existing rows changed by expressions over the old
    row (``old.<column>``) and the given one (``new.<column>``). Keys of ``rows`` are different."""
    o, n = base.alias("old"), rows.select(*base.columns).alias("new")
    on = reduce(Column.__and__, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys])
    there, given = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()
    out = []
    for c in base.columns:
        changed = on_duplicate.get(c, F.col(f"old.{c}"))
        out.append(F.when(there & given, changed).when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).cast(base.schema[c].dataType).alias(c))
    return o.join(n, on, "full").select(*out)


def update(base: DataFrame, where: Column, assign: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Rows for which ``where`` is true get new values. A change of the key must leave it unique."""
    out = base.select(*[F.when(where, assign[c]).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in assign else F.col(c) for c in base.columns])
    if keys and set(keys) & set(assign):
        require_empty(duplicates(out, keys), "duplicate key")
    return out


def update_join(base: DataFrame, other: DataFrame, on: Column, assign: dict[str, Column], keys: list[str]) -> DataFrame:
    """UPDATE ... JOIN: ``base`` as b and ``other`` as o; a row with several matches is changed once."""
    hits = base.alias("b").join(other.alias("o"), on).select(*[F.col(f"b.{k}").alias(k) for k in keys], *[v.alias(f"_new_{c}") for c, v in assign.items()])
    hits = hits.groupBy(*keys).agg(*[F.min(f"_new_{c}").alias(f"_new_{c}") for c in assign], F.lit(True).alias("_hit"))
    both = base.join(hits, keys, "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in assign else F.col(c) for c in base.columns])


def delete(base: DataFrame, where: Column) -> DataFrame:
    """Only rows for which ``where`` is true go; NULL keeps them."""
    return base.where(~F.coalesce(where, F.lit(False)))


def delete_join(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(other.select(*keys), keys, "left_anti").select(*base.columns)


def delete_keyless(base: DataFrame, rows: DataFrame) -> DataFrame:
    """From a table without a key: for each given row one row equal in every column goes.

    Equal rows are counted, not numbered, so that very many of them stay cheap.
    """
    names = base.columns
    left = base.groupBy(*names).agg(F.count("*").alias("_n"))
    gone = rows.select(*names).groupBy(*names).agg(F.count("*").alias("_m"))
    on = reduce(Column.__and__, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in names])
    both = left.alias("a").join(gone.alias("b"), on, "left").select(*[F.col(f"a.`{c}`") for c in names], (F.col("_n") - F.coalesce("_m", F.lit(0))).alias("_k"))
    return both.where("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_k"))).select(*names)


def truncate(base: DataFrame) -> tuple[DataFrame, int]:
    """An empty table, and how many rows there were."""
    return base.limit(0), base.count()


def auto_increment(rows: DataFrame, column: str, following: int, order: str) -> DataFrame:
    """Rows without a value in ``column`` get ``following``, and on, in the order of another column; an
    explicit value above the counter raises it for the rows after it.

    Without explicit values the numbers are global ranks. With them the largest need so far is carried
    over the explicit rows alone, and each blank takes that of the last explicit row before it.
    """
    kind = rows.schema[column].dataType
    numbered = global_rank(rows, order, name="_at")
    blanks = global_rank(numbered.where(F.col(column).isNull()), "_at", name="_b")
    given = numbered.where(F.col(column).isNotNull())
    if given.isEmpty():
        return blanks.withColumn(column, (F.col("_b") + following - 1).cast(kind)).select(*rows.columns)
    # blanks before an explicit row: its place less its place among the explicit ones
    marks = global_rank(given, "_at", name="_g").withColumn("_need", F.col(column).cast("long") + 1 - (F.col("_at") - F.col("_g")))
    events = marks.select("_at", "_need").unionByName(blanks.select("_at", F.lit(None).cast("long").alias("_need")))
    need = running_max(events, "_at", "_need")
    value = F.col("_b") - 1 + F.greatest(F.coalesce("_most", F.lit(following)), F.lit(following))
    filled = blanks.join(need.select("_at", "_most"), "_at").withColumn(column, value.cast(kind)).select(*rows.columns)
    return filled.unionByName(given.select(*rows.columns))


def running_max(df: DataFrame, order: str, value: str, out: str = "_most", parts: int = 1 << 16) -> DataFrame:
    """The largest value so far in the order of a gapless rank: within blocks, then over the blocks."""
    block = F.floor(F.col(order) / parts)
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", block).withColumn("_in", F.max(value).over(inner))
    tops = rows.groupBy("_block").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    return rows.join(tops.select("_block", before.alias("_before")), "_block").withColumn(out, F.greatest("_in", "_before")).drop("_block", "_in", "_before")
