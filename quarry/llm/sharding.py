"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A document's id hashes to a cell; every virtual node sits on a
cell, and a document belongs to the first one clockwise. A shard takes no more than its capacity: what
overflows continues clockwise to the next shard with room. The capacities add up to the number of
documents and differ by one at most, so the shards do too.

Only the count of each cell goes to the driver (a fixed number of rows); the ring is walked there once,
which gives each cell a few runs of ranks with their shard and first slot. Equal documents are counted, not
ranked one by one, and large cells are cut by hash, so no task holds a shard, a hot id or a hot text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, read, tasks

CELLS = 1 << 16
VIRTUAL = 128  # virtual nodes of a shard
SHARDS = 24
BLOCK = 65_536  # groups that are ranked in one task, and slots that one task writes for a group


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the first virtual node clockwise."""
    rows = spark.range(shards * virtual).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("node"), (F.col("id") % shards), F.floor(F.col("id") / shards)), F.lit(cells)).cast("int").alias("cell"),
    )
    at: dict[int, int] = {}
    for r in rows.collect():
        at[r["cell"]] = min(r["shard"], at.get(r["cell"], shards))
    owner, owners = at[min(at)], [0] * cells
    for c in range(cells - 1, -1, -1):
        owner = at.get(c, owner)
        owners[c] = owner
    return owners


def walk(owners: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of every run of documents."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, runs, queue = [0] * shards, [], []

    def put(cell: int, first: int, n: int, shard: int) -> int:
        take = min(n, room[shard])
        if take:
            runs.append((cell, first, first + take, shard, filled[shard]))
            filled[shard] += take
            room[shard] -= take
        return take

    for cell, n in enumerate(counts):  # each shard first takes what belongs to it
        if n and (take := put(cell, 0, n, owners[cell])) < n:
            queue.append((cell, take, n - take))
    heads = [c for c in range(len(owners)) if owners[c] != owners[c - 1]]  # where another owner begins
    for cell, first, n in queue:  # the rest goes on clockwise from its own cell
        k = next((i for i, h in enumerate(heads) if h > cell), 0)
        while n:
            take = put(cell, first, n, owners[heads[k % len(heads)]])
            first, n, k = first + take, n - take, k + 1
    return runs


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text).

    size is the UTF-8 bytes of the text plus 8 (null: 8), text_crc32 that of the text (null: of the
    empty text). Slots of a shard go from 0 without a gap. Rows that are equal in doc_id, size and crc can't
    be told apart: they are one group with as many slots. The groups of a cell are cut by hash into pieces of
    about ``block``, and ranked by doc_id, size and crc within their piece; null ids have a cell like any
    other. An empty table gives an empty one. Other columns are ignored, the text itself is never shuffled.
    Law: the counts of the shards differ by one at most.
    """
    spark = docs.sparkSession
    text, same = F.coalesce("text", F.lit("")), ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    cell = F.pmod(F.xxhash64(F.lit("key"), "doc_id"), F.lit(cells)).cast("int")
    groups = materialize(rows.groupBy(*same).agg(F.count("*").alias("n")).withColumn("cell", cell), "keys")
    counts, pieces = [0] * cells, []
    for r in groups.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).toLocalIterator():
        counts[r["cell"]] = r["n"]
        if r["groups"] > block:
            pieces.append((r["cell"], -(-r["groups"] // block)))
    runs = walk(ring(spark, shards, virtual, cells), counts, shards)
    plan = spark.createDataFrame(runs, "cell int, first bigint, end bigint, shard int, slot bigint")
    none = F.lit(0).cast("long")
    if pieces:  # of fixed number: at most one row for each cell
        groups = groups.join(F.broadcast(spark.createDataFrame(pieces, "cell int, pieces bigint")), "cell", "left")
        groups = groups.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), *same), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    else:
        groups = groups.withColumn("piece", none)
    upto = F.sum("n").over(Window.partitionBy("cell", "piece").orderBy(*same).rowsBetween(Window.unboundedPreceding, 0))
    ranked = groups.withColumn("to", upto)
    if pieces:
        before = F.sum("m").over(Window.partitionBy("cell").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
        starts = groups.groupBy("cell", "piece").agg(F.sum("n").alias("m")).select("cell", "piece", F.coalesce(before, none).alias("before")).where("before > 0")
        ranked = ranked.join(materialize(starts, "pieces"), ["cell", "piece"], "left").withColumn("to", F.col("to") + F.coalesce("before", none))
    ranked = ranked.withColumn("from", F.col("to") - F.col("n")).alias("r")
    # at most a few runs for each of a fixed number of cells: about 3 MB at the default
    low, high = F.greatest("from", "first"), F.least("to", "end")
    joined = ranked.join(F.broadcast(plan.alias("p")), (F.col("r.cell") == F.col("p.cell")) & (F.col("from") < F.col("end")) & (F.col("to") > F.col("first")))
    joined = joined.select(*same, "shard", (F.col("slot") + low - F.col("first")).alias("slot"), (high - low).alias("n"))
    some = joined.where(F.col("n") <= block).withColumn("i", F.explode(F.sequence(none, F.col("n") - 1)))
    # a group with very many slots is dealt out in blocks
    many = joined.where(F.col("n") > block).withColumn("b", F.explode(F.sequence(none, F.col("n") - 1, F.lit(block).cast("long")))).repartition(tasks(spark), "shard", "slot", "b")
    many = many.withColumn("i", F.explode(F.sequence(F.col("b"), F.least(F.col("b") + block, F.col("n")) - 1))).drop("b")
    return some.unionByName(many).select(*same, "shard", (F.col("slot") + F.col("i")).alias("slot"))


def op5_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is rows) of every row of
    documents, as :func:`shard` says of nulls, empty texts, repeated rows, hot ids and an empty table."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
