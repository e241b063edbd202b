"""Full-text search: an inverted index as DataFrames, and scores of MATCH ... AGAINST."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.staging import staged

_TOKEN = r"[\p{L}\p{N}_]+"


@dataclass
class Index:
    """positions (id, word, place), doc_counts (id, word, tf), global_counts (word, df), n_rows."""

    positions: DataFrame
    doc_counts: DataFrame
    global_counts: DataFrame
    n_rows: DataFrame


def tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def index(df: DataFrame, key: str, text: str, least: int = 3) -> Index:
    """Words of at least ``least`` characters, lower-cased, with their places."""
    pos = df.select(F.col(key).alias("id"), F.posexplode(tokens(F.col(text))).alias("place", "word")).where(F.length("word") >= least)
    doc = pos.groupBy("id", "word").agg(F.count("*").alias("tf"))
    return Index(pos, doc, doc.groupBy("word").agg(F.count("*").alias("df")), df.agg(F.count("*").alias("n")))


def match(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """id and score of the rows that hold any of the words: the sum of tf x idf squared, idf being the
    decadic logarithm of rows over rows with the word. Only the searched words leave the scan."""
    wanted = sorted({w.lower() for w in words})
    low = F.lower(F.col(text))
    some = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in wanted], F.lit(False))  # cheaper than the tokens
    pos = df.where(some).select(F.col(key).alias("id"), F.explode(F.filter(tokens(F.col(text)), lambda w: w.isin(*wanted))).alias("word"))
    doc = pos.groupBy("id", "word").agg(F.count("*").alias("tf"))
    df_counts = doc.groupBy("word").agg(F.count("*").alias("df"))  # a row for each searched word
    total = df.agg(F.count("*").alias("n"))
    scored = doc.join(F.broadcast(df_counts), "word").crossJoin(F.broadcast(total))
    idf = F.log10(F.col("n") / F.col("df"))
    return scored.groupBy("id").agg(F.round(F.sum(F.col("tf") * idf * idf), 6).alias("score"))


def boolean_match(text: str, must: list[str] = (), must_not: list[str] = (), any_of: list[str] = ()):
    """Filter of IN BOOLEAN MODE: +must -must_not any."""
    own = tokens(F.col(text))
    out = F.lit(True)
    for w in must:
        out = out & F.array_contains(own, w.lower())
    for w in must_not:
        out = out & ~F.array_contains(own, w.lower())
    if any_of:
        out = out & F.arrays_overlap(own, F.array(*[F.lit(w.lower()) for w in any_of]))
    return out


# A stored index: words are dealt by hash into folders, so a search reads only the folders of its words.
BUCKETS = 64


def _bucket(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _counted(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """id, word, tf and the places of each word of a row."""
    pos = df.select(F.col(key).alias("id"), F.posexplode(tokens(F.col(text))).alias("place", "word")).where(F.length("word") >= least)
    return pos.groupBy("id", "word").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))


def _write(docs: DataFrame, n: DataFrame, path: str) -> None:
    docs.withColumn("bucket", _bucket("word")).write.partitionBy("bucket").parquet(f"{path}/docs")
    words = docs.sparkSession.read.parquet(f"{path}/docs").groupBy("bucket", "word").agg(F.count("*").alias("df"))
    words.write.partitionBy("bucket").parquet(f"{path}/words")
    n.write.parquet(f"{path}/rows")


def store(df: DataFrame, key: str, text: str, path: str) -> None:
    """Write an inverted index: words of rows with their places, counts of words over rows, number of rows."""
    _write(_counted(df, key, text), df.agg(F.count("*").alias("n")), path)


def update(spark: SparkSession, old: str, new: str, before: DataFrame, after: DataFrame, key: str, text: str) -> None:
    """The index of a later version from that of an earlier one: rows that are gone or changed leave it, and only
    those that came or changed are cut into words. Ids of both versions are compared by a hash of their text."""
    mark = lambda d, n: d.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias(n))
    both = mark(before, "a").join(mark(after, "b"), "id", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("id")
    both = staged(both, "changed")
    fresh = after.join(both, after[key] == both["id"], "left_semi")
    stay = spark.read.parquet(f"{old}/docs").drop("bucket").join(both, "id", "left_anti")
    _write(stay.unionByName(_counted(fresh, key, text)), after.agg(F.count("*").alias("n")), new)


def match_stored(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """id and score as of :func:`match`, read from the folders of the searched words alone."""
    wanted = sorted({w.lower() for w in words})
    rows = spark.createDataFrame([(w,) for w in wanted], "word string").select("word", _bucket("word").alias("bucket")).collect()
    some = F.col("bucket").isin(*sorted({r["bucket"] for r in rows})) & F.col("word").isin(*wanted)
    docs = spark.read.parquet(f"{path}/docs").where(some).select("id", "word", "tf")
    counts = spark.read.parquet(f"{path}/words").where(some).select("word", "df")  # a row for each searched word
    scored = docs.join(F.broadcast(counts), "word").crossJoin(F.broadcast(spark.read.parquet(f"{path}/rows")))
    idf = F.log10(F.col("n") / F.col("df"))
    return scored.groupBy("id").agg(F.round(F.sum(F.col("tf") * idf * idf), 6).alias("score"))


def phrase_stored(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Ids of the rows that hold the words one after the other, from the stored places."""
    low = [w.lower() for w in words]
    found = None
    for i, w in enumerate(low):
        at = spark.read.parquet(f"{path}/docs").where((F.col("bucket") == _bucket(F.lit(w))) & (F.col("word") == w))
        shift = F.lit(i)
        own = at.select("id", F.transform("places", lambda p: p - shift).alias(f"p{i}"))  # noqa: B023
        found = own if found is None else found.join(own, "id")
    common = F.col("p0")
    for i in range(1, len(low)):
        common = F.array_intersect(common, F.col(f"p{i}"))
    return found.where(F.size(common) > 0).select("id")
