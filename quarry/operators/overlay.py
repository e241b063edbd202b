"""Overlay of an ordered edit log on a base table: the last edit of each key wins.

An edit has ``seq`` (its place), ``op`` (insert, update or delete), ``old`` (struct of the key it is based
on; null for an insert) and ``row`` (struct of the whole new row; null for a delete).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit_rows(df: DataFrame, keys: list[str], op: str, seq: Column, old: Column | None = None) -> DataFrame:
    """Edits from rows: the whole row for insert and update, its key for delete."""
    names = [f"`{c}`" for c in df.columns]
    own = F.struct(*[F.col(f"`{k}`") for k in keys])
    row = F.struct(*names)
    none = F.lit(None)
    return df.select(
        seq.cast("long").alias("seq"),
        F.lit(op).alias("op"),
        (none.cast(_kind(df, keys)) if op == "insert" else own if old is None else old).alias("old"),
        (none.cast(df.schema) if op == "delete" else row).alias("row"),
    )


def _kind(df: DataFrame, keys: list[str]):
    from pyspark.sql import types as T

    return T.StructType([df.schema[k] for k in keys])


def last_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the keys, ``row`` and ``gone``, as the edits leave it.

    An update that moves a key ends the old key at its own place in the order and begins the new one just
    after; a later insert at the old key brings it back. The last edit of a key is found by an aggregate
    that is combined before the exchange, so a key with very many edits stays cheap.
    """
    new = F.struct(*[F.col(f"row.`{k}`").alias(k) for k in keys])
    moved = (F.col("op") == "update") & ~F.col("old").eqNullSafe(new)
    steps = F.array(
        F.when((F.col("op") == "delete") | moved, F.struct(F.col("old").alias("k"), F.lit(0).alias("sub"), F.lit(True).alias("gone"))),
        F.when(F.col("op") != "delete", F.struct(new.alias("k"), F.lit(1).alias("sub"), F.lit(False).alias("gone"))),
    )
    flat = edits.select("seq", "row", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    flat = flat.select(*[F.col(f"s.k.`{k}`").alias(k) for k in keys], F.struct("seq", "s.sub").alias("at"), F.struct("s.gone", F.when(~F.col("s.gone"), F.col("row")).alias("row")).alias("x"))
    last = flat.groupBy(*keys).agg(F.max_by("x", "at").alias("x"))
    return last.select(*keys, F.col("x.row").alias("row"), F.col("x.gone").alias("gone"))


def merge(base: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the edits. With few edits the base isn't shuffled: the anti join is broadcast."""
    last = last_edits(edits, keys)
    kept = base.join(last.select(*keys), keys, "left_anti").select(*base.columns)
    return kept.unionByName(last.where("not gone").select(*[F.col(f"row.`{c}`").alias(c) for c in base.columns]))


def conflicts(base: DataFrame, seen: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Keys whose row in ``base`` is no longer the one that an edit was based on ("row changed"). ``touched``:
    the keys of the edits, those too that had no row in ``seen`` and must not have one now; without it the
    keys of ``seen``."""
    image = lambda d, n: d.select(*keys, F.xxhash64(*d.columns).alias(n))
    own = seen.select(*keys) if touched is None else touched.select(*keys).distinct()
    both = own.join(image(seen, "was"), keys, "left").join(image(base.select(*seen.columns), "now"), keys, "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(*keys)
