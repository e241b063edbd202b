"""Helpers shared by the corpus operators: tables in the shared folder, names, work dealing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master (tests, one machine) may leave it
    unset; then a temporary folder is made once and remembered in the session.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._quarry_shipped = True


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts lineage in a way that survives a lost executor, and gives the planner true sizes, so
    that joins with the table are broadcast only when it is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for a compute-bound exchange that must not be merged because it is small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def end_to_end(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with ``end_at``, the running total of the column ``size`` in the order of ``keys``, and
    ``at``, which orders rows of equal keys. ``rows`` is a table that reads the same each time.

    Rows are dealt out by ranges of the keys (equal ones by their place in the table, so any number of them is
    split) and summed there; the totals of the ranges, one row for each partition, give where each begins.
    """
    spark = rows.sparkSession
    own = rows.withColumn("at", F.monotonically_increasing_id())
    own = own.repartitionByRange(tasks(spark), *keys, "at").withColumn("_q_part", F.spark_partition_id())
    own = materialize(own, "ranges")
    totals = own.groupBy("_q_part").agg(F.sum(size).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_q_part", before.alias("_q_before"))  # a row for each partition
    inner = F.sum(size).over(Window.partitionBy("_q_part").orderBy(*keys, "at").rowsBetween(Window.unboundedPreceding, 0))
    out = own.withColumn("_q_end", inner).join(F.broadcast(totals), "_q_part")
    return out.withColumn("end_at", (F.col("_q_end") + F.col("_q_before")).cast("long")).drop("_q_part", "_q_end", "_q_before")


def texts_of(array: pa.Array, rows: int = 128) -> Iterator[list[bytes | None]]:
    """The UTF-8 of a batch of strings, a few at a time, so that a worker never holds all of them twice."""
    array = array.cast(pa.binary())
    for s in range(0, len(array), rows):
        yield array.slice(s, rows).to_pylist()


BLOOM_WORDS = 1 << 18  # 2 MB of bits, whatever they stand for


def bloom(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for long values: true for all of ``column``, false for most others.

    The bits have a fixed size, so they may go to the driver and to every task. It only saves work: with
    very many keys it lets more of the others pass, and what passes must be joined with the keys.
    """
    spark = keys.sparkSession
    probe = lambda c: [F.xxhash64(F.lit(i), c) for i in range(3)]
    at = [F.struct(F.pmod(p, F.lit(BLOOM_WORDS)).cast("int").alias("word"), F.shiftrightunsigned(p, 58).cast("int").alias("bit")) for p in probe(F.col(column))]
    rows = keys.select(F.explode(F.array(*at)).alias("x")).groupBy("x.word").agg(F.bit_or(F.expr("shiftleft(1L, x.bit)")).alias("bits")).toArrow()
    words = np.zeros(BLOOM_WORDS, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def test(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bits = shared.value.view(np.uint64)
        for arrays in batches:
            ok = np.ones(len(arrays[0]), dtype=bool)
            for a in arrays:
                p = a.to_numpy()
                ok &= (bits[p % BLOOM_WORDS] >> (p.view(np.uint64) >> np.uint64(58))) & np.uint64(1) == 1
            yield pa.array(ok)

    return lambda c: test(*probe(c))


def bloom_flag(rows: DataFrame, key: Column, keys: DataFrame, own: Column, name: str = "_q_maybe") -> DataFrame:
    """``rows`` with a boolean column: true where ``key`` is among the values ``own`` of ``keys``, and for a
    few others. The same filter as :func:`bloom` in DataFrame operations alone: its words, a fixed number at
    most, are a broadcast table."""
    probes = lambda c: [F.xxhash64(F.lit(i), c) for i in range(2)]
    word = lambda p: F.pmod(p, F.lit(BLOOM_WORDS)).cast("int")
    bit = lambda p: F.shiftrightunsigned(p, 58).cast("int")
    at = [F.struct(word(p).alias("word"), bit(p).alias("bit")) for p in probes(own)]
    words = keys.select(F.explode(F.array(*at)).alias("x")).groupBy("x.word").agg(F.bit_or(F.expr("shiftleft(1L, x.bit)")).alias("bits"))
    words = materialize(words, "bloom")
    out, flag = rows, F.lit(True)
    for i, p in enumerate(probes(key)):
        out = out.withColumn(f"_q_p{i}", p)
    for i in range(2):
        w = words.select(F.col("word").alias(f"_q_w{i}"), F.col("bits").alias(f"_q_b{i}"))
        out = out.join(F.broadcast(w), word(F.col(f"_q_p{i}")) == F.col(f"_q_w{i}"), "left")
        out = out.withColumn(f"_q_s{i}", bit(F.col(f"_q_p{i}")))
        flag = flag & F.coalesce(F.expr(f"shiftrightunsigned(_q_b{i}, _q_s{i}) & 1L") == 1, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], flag.alias(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
