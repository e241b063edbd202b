"""Change capture and replay: changelogs from versions, grouping, filters, and idempotent application,
as batches and as streams.

A change has ``seq``, ``gtid`` (its transaction), ``db``, ``tbl``, ``op`` (insert, update, delete),
``before`` and ``after`` (the rows).
"""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.overlay import merge
from quarry.sources.staging import staged
from quarry.sources.storage import VersionedTable


def capture(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """op, the keys, before and after of every row that differs between two versions."""
    a = before.select(*keys, F.struct(*before.columns).alias("before"))
    b = after.select(*keys, F.struct(*after.columns).alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    both = a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(op.alias("op"), *keys, "before", "after")


def grouped(changes: DataFrame, by: str = "gtid") -> DataFrame:
    """Consecutive changes of one table and kind within a transaction, as (gtid, island, db, tbl, op, n,
    first_seq, last_seq): what one event of a log holds.

    Runs are found within each transaction, so no task sees the whole log.
    """
    w = Window.partitionBy(by).orderBy("seq")
    kind = F.struct("db", "tbl", "op")
    new = F.coalesce((~kind.eqNullSafe(F.lag(kind).over(w))).cast("long"), F.lit(1))
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    rows = changes.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "island", "db", "tbl", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def events(changes: DataFrame, by: str = "gtid") -> DataFrame:
    """The events of a log, in order of ``seq`` and ``place``: for every transaction GTID, BEGIN, one ROWS event
    for each run of changes of one table and kind (n rows), and XID; for a schema change (op "ddl", its text in
    ``statement``) GTID and QUERY. No change, no event.
    """
    text = F.col("statement") if "statement" in changes.columns else F.lit(None).cast("string")
    ddl = changes.where("op = 'ddl'").select(by, "seq", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("event"), F.when(F.lit(k == "QUERY"), t).alias("text")) for i, (k, t) in enumerate((("GTID", text), ("QUERY", text)))])).alias("e"))
    ddl = ddl.select(by, "seq", "e.place", "e.event", "e.text", F.lit(0).cast("long").alias("n"))
    runs = grouped(changes.where("op <> 'ddl'"), by)
    ends = runs.groupBy(by).agg(F.min("first_seq").alias("low"), F.max("last_seq").alias("high"))
    mark = lambda at, place, name: F.struct(F.col(at).alias("seq"), F.lit(place).alias("place"), F.lit(name).alias("event"))
    frame = ends.select(by, F.explode(F.array(mark("low", 0, "GTID"), mark("low", 1, "BEGIN"), mark("high", 9, "XID"))).alias("e"))
    frame = frame.select(by, "e.seq", "e.place", "e.event", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    rows = runs.select(by, F.col("first_seq").alias("seq"), F.lit(2).alias("place"), F.lit("ROWS").alias("event"), F.concat_ws(" ", "op", F.concat_ws(".", "db", "tbl")).alias("text"), "n")
    return frame.unionByName(rows).unionByName(ddl)


def deduplicated(changes: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each change once, and none that was executed before. ``done`` has gtid, and seq if a transaction may
    be known in part: then its changes up to that one were executed."""
    once = changes.dropDuplicates(["gtid", "seq"])
    if done is None:
        return once
    if "seq" not in done.columns:
        return once.join(done.select("gtid"), "gtid", "left_anti")
    last = done.groupBy(F.col("gtid").alias("_gtid")).agg(F.max("seq").alias("_seq"))
    return once.join(last, F.col("gtid").eqNullSafe(F.col("_gtid")) & (F.col("seq") <= F.col("_seq")), "left_anti")


def after(changes: DataFrame, seq: int) -> DataFrame:
    """What a reader that has seen ``seq`` still needs."""
    return changes.where(F.col("seq") > seq)


@dataclass(frozen=True)
class Filters:
    """Replication filters. What is ignored stays ignored whatever else names it."""

    do_db: tuple[str, ...] = ()
    ignore_db: tuple[str, ...] = ()
    do_table: tuple[str, ...] = ()
    wild_do: tuple[str, ...] = ()
    ignore_table: tuple[str, ...] = ()
    wild_ignore: tuple[str, ...] = ()

    def column(self) -> Column:
        name = F.lower(F.concat_ws(".", "db", "tbl"))
        db = F.lower("db")
        low = lambda v: [x.lower() for x in v]
        yes = F.lit(True)
        if self.do_db:
            yes = yes & db.isin(*low(self.do_db))
        if self.do_table or self.wild_do:
            named = name.isin(*low(self.do_table)) if self.do_table else F.lit(False)
            yes = yes & reduce(Column.__or__, [name.like(p.lower()) for p in self.wild_do], named)
        no = F.lit(False)
        if self.ignore_db:
            no = no | db.isin(*low(self.ignore_db))
        if self.ignore_table:
            no = no | name.isin(*low(self.ignore_table))
        no = reduce(Column.__or__, [name.like(p.lower()) for p in self.wild_ignore], no)
        return yes & ~no


def lag_seconds(progress: DataFrame, now: Column) -> DataFrame:
    """Seconds behind the source of each stream: now less its last event, never negative, 0 when idle."""
    behind = F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds("last_event"))
    return progress.select("*", F.when(F.col("idle"), 0).otherwise(F.coalesce(behind, F.lit(0))).cast("long").alias("seconds_behind"))


def edits(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes as edits for :func:`quarry.operators.overlay.merge`."""
    old = F.struct(*[F.col(f"before.`{k}`").alias(k) for k in keys])
    return changes.select("seq", "op", F.when(F.col("op") != "insert", old).alias("old"), F.when(F.col("op") != "delete", F.col("after")).alias("row"))


def apply(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes, in order of seq."""
    return merge(base, edits(changes, keys), keys)


def apply_partial(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after changes whose images may lack columns: ``present`` lists those that an update gives, the
    others keep their values; an insert gives all. ``before`` needs the keys alone, which no update may move.
    An update of a row that isn't there changes nothing.

    Every column's last value is combined before the exchange; the table is joined to one row for each changed key.
    """
    rest = [c for c in base.columns if c not in keys]
    image = F.when(F.col("op") == "insert", F.struct(*[F.col(f"after.`{k}`").alias(k) for k in keys])).otherwise(F.struct(*[F.col(f"before.`{k}`").alias(k) for k in keys]))
    full = F.col("op") != "update"
    moved = [F.array_contains("present", k) & ~F.col(f"after.`{k}`").eqNullSafe(F.col(f"before.`{k}`")) for k in keys]
    stays = F.when((F.col("op") == "update") & reduce(Column.__or__, moved), F.raise_error(F.lit("a partial image can't move its key"))).otherwise(True)
    rows = changes.where(stays).withColumn("_key", image)
    given = lambda c: (F.col("op") == "insert") | ((F.col("op") == "update") & F.array_contains("present", c))
    value = lambda c: F.struct("seq", F.col(f"after.`{c}`").alias("value"))
    lasts = [F.max_by(F.when(given(c), value(c)), F.when(given(c), F.col("seq"))).alias(f"_c{i}") for i, c in enumerate(rest)]
    last = rows.groupBy("_key").agg(F.max(F.when(full, F.struct("seq", "op"))).alias("_full"), *lasts)
    last = staged(last.select(*[F.col(f"_key.`{k}`").alias(k) for k in keys], "_full", *[f"_c{i}" for i in range(len(rest))], F.lit(True).alias("_hit")), "last")
    kept = base.join(last, keys, "left").where(F.col("_hit").isNull() | F.col("_full").isNull())
    merged = [F.when(F.col(f"_c{i}").isNull(), F.col(f"`{c}`")).otherwise(F.col(f"_c{i}.value")).alias(c) for i, c in enumerate(rest)]
    fresh = last.where("_full.op = 'insert'").select(*keys, *[F.col(f"_c{i}.value").alias(c) for i, c in enumerate(rest)])
    return kept.select(*keys, *merged).unionByName(fresh).select(*base.columns)


def start_applying(spark: SparkSession, source: str, schema, table: VersionedTable, keys: list[str], checkpoint: str, filters: Filters | None = None, compact_after: int = 20, every: str | None = None):
    """Follow a folder of changelog files and apply each micro-batch exactly once.

    The number of the batch is stored in the version that it makes: a batch that is delivered again after
    a failure finds it there and is skipped. The executed set (the last change of each transaction) is kept
    with the table, so a transaction that is delivered again in a later file is not applied again. A batch
    writes its edits alone; after ``compact_after`` of them the table and the set are written anew. Returns the
    streaming query; it stops when all is read, or goes on and looks for more ``every`` so often.
    """

    def one(batch: DataFrame, number: int) -> None:
        version = table.version()
        meta = table.meta(version)
        if meta.get("batch", -1) >= number:
            return
        known = meta.get("executed", [])
        done = spark.read.parquet(*[f"{table.path}/{f}" for f in known]) if known else None
        rows = staged(deduplicated(batch, done), "changes")
        own = rows.groupBy("gtid").agg(F.max("seq").alias("seq"))
        if len(known) >= compact_after:
            known, own = [], done.unionByName(own).groupBy("gtid").agg(F.max("seq").alias("seq"))
        rows = rows.where(filters.column()) if filters else rows  # what a filter leaves out is executed all the same
        table.commit_edits(edits(rows, keys), keys, version, batch=number, executed=[*known, table.stage(own)])
        table.compact(compact_after)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def write_log(changes: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """Append to a changelog folder; a file is closed after ``max_rows``."""
    changes.write.mode("append").option("maxRecordsPerFile", max_rows).parquet(path)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of the files of a changelog."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def log_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: the newest file and its size, how many transactions the log holds, and its last change."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), "modificationTime")
    newest = files.agg(F.max(F.struct("modificationTime", "file", "size")).alias("x")).select("x.file", F.col("x.size").alias("position"))
    # both sides are one row
    return newest.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.count_distinct("gtid").alias("executed"), F.max("seq").alias("last_seq"))))


def matches(pattern: str, value: str) -> bool:
    """The wildcard rule of the filters for one name: % and _, any case, the whole name."""
    return fnmatch.fnmatchcase(value.lower(), pattern.lower().replace("[", "[[]").replace("*", "[*]").replace("?", "[?]").replace("%", "*").replace("_", "?"))


def position(table: VersionedTable) -> str:
    """What a replica reports: its version and the last batch it holds."""
    m = table.meta()
    return json.dumps({"version": table.version(), "batch": m.get("batch", -1)})
