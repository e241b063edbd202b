"""Range-sharded tables: placement by ranges of an integer key, global reads, splits, uniqueness."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.constraints import duplicates
from quarry.operators.rank import global_rank
from quarry.operators.transactions import Session
from quarry.plans.router import KeyRange, Pred, RouteError, route, span
from quarry.sources.storage import VersionedTable


def range_of(column: str, ranges: list[KeyRange]) -> Column:
    """The group of each row; NULL where no range holds its key."""
    out = F.lit(None).cast("string")
    for r in reversed(ranges):
        out = F.when(r.predicate(column), r.group).otherwise(out)
    return out


def placed(df: DataFrame, column: str, ranges: list[KeyRange]) -> DataFrame:
    """Rows with their ``range_id``, the column to partition the stored table by."""
    return df.withColumn("range_id", range_of(column, ranges))


def pruned(df: DataFrame, column: str, ranges: list[KeyRange], p: Pred | None, where: Column) -> DataFrame:
    """Rows of a placed table for which ``where`` holds: the groups that the predicate can't touch are
    left out by a filter on the partition column. A contradiction gives no row but keeps the schema."""
    r = route(p, column, ranges)
    if r.kind == "empty":
        return df.limit(0)
    return df.where(F.col("range_id").isin(*r.groups) & where)


def per_range(df: DataFrame, ranges: list[KeyRange], f) -> DataFrame:
    """What ``f`` gives on each range by itself, concatenated in their order: for seeing the ranges, since
    aggregates, limits and orders of the parts are not those of the table."""
    groups = list(dict.fromkeys(r.group for r in ranges))
    return reduce(DataFrame.unionByName, [f(df.where(F.col("range_id") == g)).withColumn("range_id", F.lit(g)) for g in groups])


def split_key(df: DataFrame, column: str) -> int | None:
    """The key of 1-based rank n div 2; None with fewer than two rows."""
    n = df.count()
    if n < 2:
        return None
    return global_rank(df.select(column), column).where(F.col("rn") == n // 2).first()[column]


def split(ranges: list[KeyRange], at: int, group: str) -> list[KeyRange]:
    """Keys above ``at`` move to ``group``; ``at`` itself stays on the left."""
    out = []
    for r in ranges:
        inside = (r.start is None or r.start <= at) and (r.end is None or at + 1 < r.end)
        out += [KeyRange(r.group, r.start, at + 1), KeyRange(group, at + 1, r.end)] if inside else [r]
    return out


class RangedTable:
    """A table stored in one folder for each range, so that a predicate reads only the ranges it can touch
    and a split writes only the range that is split."""

    def __init__(self, table: VersionedTable, column: str):
        self.table, self.column = table, column

    @classmethod
    def create(cls, spark, path: str, rows: DataFrame, column: str, ranges: list[KeyRange]) -> RangedTable:
        """Rows outside all ranges are an error."""
        table = VersionedTable(spark, path)
        if not placed(rows, column, ranges).where("range_id is null").isEmpty():
            raise RouteError("no range holds some keys")
        parts = [vars(r) | {"folder": table.stage(rows.where(r.predicate(column)))} for r in ranges]
        table.publish(parts[0]["folder"], None, ranges=parts, range_column=column)
        return cls(table, column)

    def parts(self) -> list[tuple[KeyRange, str]]:
        return [(KeyRange(p["group"], p["start"], p["end"], p["copying"]), p["folder"]) for p in self.table.meta()["ranges"]]

    def read(self, p: Pred | None = None, where: Column | None = None) -> DataFrame:
        """All rows, or those for which ``where`` holds, from the folders that ``p`` can touch. A
        contradiction gives no row but keeps the schema."""
        m, own, s = self.table.meta(), self.parts(), span(p, self.column)
        hit = [] if s.empty() else [f for r, f in own if r.meets(s)]
        out = self.table.spark.read.parquet(*[f"{self.table.path}/{f}" for f in hit or [own[0][1]]])
        out = self.table.merged(out, m) if hit else out.limit(0)
        if hit and m.get("edits") and len(hit) < len(own):  # edits are those of all ranges
            out = out.where(reduce(Column.__or__, [r.predicate(self.column) for r, f in own if f in hit]))
        return out if where is None else out.where(where)

    def begin(self, keys: list[str], level: str = "repeatable read") -> Session:
        """A transaction over all ranges: one log of edits, so it commits in all of them or in none."""
        return RangedSession(self.table, keys, level, ranged=self)

    def _stage_halves(self, at: int, group: str, own: list[tuple[KeyRange, str]], rows: DataFrame) -> list[dict]:
        out = []
        for r, f in own:
            halves = split([r], at, group)
            for h in halves:
                folder = f if len(halves) == 1 else self.table.stage(rows.where(h.predicate(self.column)))
                out.append({"group": h.group, "start": h.start, "end": h.end, "copying": False, "folder": folder})
        return out

    def split(self, at: int | None, group: str) -> int:
        """Keys above ``at`` (without it: above the middle key of the largest range) move to ``group``. While the
        halves are copied the range refuses writes; both are published at once, so no read sees a row twice or
        not at all. Edits are merged first."""
        self.table.compact()
        own = self.parts()
        size = lambda x: self.table.files.size(f"{self.table.path}/{x[1]}")
        one = lambda f: self.table.spark.read.parquet(f"{self.table.path}/{f}")
        if at is None:
            at = split_key(one(max(own, key=size)[1]), self.column)
        hit = [r for r, _ in own if len(split([r], at, group)) > 1]
        v = self.table.version()
        parts = [vars(r) | {"copying": r in hit, "folder": f} for r, f in own]
        v = self.table.publish(parts[0]["folder"], v, ranges=parts)
        rows = self.table.base(self.table.meta(v))
        out = self._stage_halves(at, group, own, rows)
        return self.table.publish(out[0]["folder"], v, ranges=out)

    def split_over(self, limit: int, name) -> list[int]:
        """Split every range with more than ``limit`` bytes at its middle key, until none is over or can be
        split; ``name``: the group of each new half, by its number. The keys at which it split."""
        done: list[int] = []
        while True:
            over = [(r, f) for r, f in self.parts() if self.table.files.size(f"{self.table.path}/{f}") > limit]
            keys = [k for _, f in over if (k := split_key(self.table.spark.read.parquet(f"{self.table.path}/{f}"), self.column)) is not None and k not in done]
            if not keys:
                return done
            self.split(keys[0], name(len(done)))
            done.append(keys[0])


@dataclass
class RangedSession(Session):
    """A session that refuses rows outside all ranges, and writes to a range that is being split."""

    ranged: RangedTable | None = None

    def _add(self, edits: DataFrame) -> None:
        ranges = [r for r, _ in self.ranged.parts()]
        column = self.ranged.column
        copying = [r for r in ranges if r.copying]
        key = F.coalesce(F.col(f"row.`{column}`"), F.col(f"old.`{column}`"))
        touched = edits.select(key.alias(column))
        if not touched.where(range_of(column, ranges).isNull()).isEmpty():
            raise RouteError("no range holds some keys")
        if copying and not touched.where(reduce(Column.__or__, [r.predicate(column) for r in copying])).isEmpty():
            raise RouteError("range is splitting")
        super()._add(edits)


def unique_across(table: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of CHECK columns that break uniqueness: ``column``, ``value`` and where ("statement" first,
    then "table"). NULLs are exempt."""
    out = []
    for c in columns:
        text = F.col(c).cast("string").alias("value")
        inner = duplicates(rows, [c]).select(F.lit(c).alias("column"), text, F.lit("statement").alias("where"))
        new = rows.where(F.col(c).isNotNull()).select(c).distinct()
        # the few given values are looked for in the table, which isn't shuffled while they are small
        outer = new.join(table.select(c), c, "left_semi").select(F.lit(c).alias("column"), text, F.lit("table").alias("where"))
        out += [inner, outer]
    return reduce(DataFrame.unionByName, out)
