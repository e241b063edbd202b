"""Near-duplicate removal by SimHash tiles within lanes of least hashes, and exact similarity.

1. Every text has a set of codes of its word runs. ``BANDS`` lanes hold the least values of the set under
   ``ROWS`` orders each; sets that agree on a lane are candidates. Sets with a similarity of s agree on none
   with a chance of (1 - s^ROWS)^BANDS: 1 in 8 million at 0.8, 1 in 10^10 at 0.85.
2. Within what the lanes connect, SimHash fingerprints of the sets are compared tile against tile with
   exclusive-or and bit counts (``simhash.near_links``). The radius follows from the similarity, for sets of any
   size: fingerprints of similar sets are further apart with a chance of less than ``CHANCE``.
3. What these connect is checked exactly: parities of the sets rule out what can't be similar and lose nothing
   (``parity.py``), the rest is compared set by set, block against block (``jaccard.py``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bloom, discard, materialize, ship, texts_of
from quarry.llm.components import components
from quarry.llm.jaccard import sets_column, shingle_set, similar_links
from quarry.llm.parity import sketch_links, sketched
from quarry.llm.simhash import near_links, set_fingerprint_column
from quarry.llm.words import mixed

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
PRINT_WORDS = 8  # of 64 bits, of a fingerprint
CHANCE = 1e-10
TILE_ROWS = 64  # fingerprints of a tile
_RNG = np.random.default_rng(8)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def lane_keys(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each lane of a set of 64-bit codes; none for an empty set."""
    if not len(codes):
        return np.empty(0, np.int64)
    high = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for s in range(0, len(high), 1024):
        x = (high[None, s : s + 1024] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = key * np.uint64(0xD6E8FEB86659FD93) + column + np.uint64(1)
    return mixed(key, 1).view(np.int64)


def prints_column(text: Column, words: int) -> Column:
    """struct<a, b, keys>: 128 bits of hash of the set of word runs, and its lane keys."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<a:bigint,b:bigint,keys:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            out = []
            for t in (t for part in texts_of(array) for t in part):
                own = shingle_set(t, words)
                a, b = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64).tolist()
                out.append({"a": a, "b": b, "keys": lane_keys(own)})
            yield pa.array(out, kind)

    return run(text)


def lane_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes with a lane key in common; ``nodes`` has node and keys."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    # the least node of a key is combined before the exchange; a hot key is a skewed join that can be split
    first = rows.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return rows.join(materialize(first, "keys"), "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()


def bit_differs(similarity: float, small: int = 24) -> float:
    """The largest chance that a bit of the fingerprints of two sets of at least ``similarity`` differs: of up to
    ``small`` common elements by counting (few elements often tie), of many by the angle."""

    def tells(common: int, own: int) -> np.ndarray:  # the chance of a one, by the ones among the common elements
        ones = np.arange(common + 1)[:, None] + np.arange(own + 1)
        return ((2 * ones > common + own) + (2 * ones == common + own) / 2) @ deals(own)

    deals = lambda n: np.array([math.comb(n, i) for i in range(n + 1)]) / 2**n
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for common in range(1, small + 1):
        for apart in range(1, math.floor(common * (1 - similarity) / similarity + 1e-6) + 1):
            for own in range((apart + 1) // 2, apart + 1):
                x, y = tells(common, own), tells(common, apart - own)
                most = max(most, float(deals(common) @ (x * (1 - y) + y * (1 - x))))
    return most


@cache
def radius(similarity: float, bits: int) -> int:
    """So many of ``bits`` bits that the fingerprints of two sets of at least ``similarity`` differ in more with a
    chance of less than ``CHANCE``."""
    p = bit_differs(similarity)
    if p == 0:
        return 0
    tail = np.cumsum([math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(bits, -1, -1)])[::-1]
    return int(np.flatnonzero(np.append(tail[1:], 0) < CHANCE)[0])


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group of similar texts the smallest doc_id stays.

    Texts are linked if the Jaccard similarity of their runs of ``words`` words is at least
    ``similarity``; groups are what links reach. Of every pair that the lanes hold together the fingerprints
    are compared, and the sets of what these connect. A pair of exactly 0.8 that no lane holds has a chance of
    1 in 8 million, one whose fingerprints are beyond the radius of less than 2 in 10^10.

    Texts without a word (null, empty, blank) are equal. Rows without a doc_id come after all others; of
    repeated rows one stays. Any other columns are kept, whatever their names. Sets are told apart by 128 bits
    of hash, and so are rows by their id and text. Of equal sets one is compared. Only rows of groups, and of
    no group a few that a filter of fixed size lets pass, are shuffled with their text. Tables of texts and sets
    are deleted as soon as nothing reads them any more; the result reads ``docs`` and a table of hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull(), F.col("text")
    marked = docs.withColumn("_q_a", F.xxhash64(F.lit("row"), *own)).withColumn("_q_b", F.xxhash64(F.lit("again"), *own))
    prints = marked.select("doc_id", "_q_a", "_q_b", prints_column(F.col("text"), words).alias("x"))
    prints = materialize(prints.select("doc_id", "_q_a", "_q_b", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.keys").alias("keys")), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_q_a", "_q_b"))
    nodes = prints.groupBy("a", "b").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"), best.alias("best"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = components(lane_links(nodes))
    # one text of each set in a group with others: sets, fingerprints, exact similarity
    lone = nodes.select("node", F.col("best._q_a").alias("_q_a"), F.col("best._q_b").alias("_q_b")).join(groups.withColumnRenamed("root", "grp"), "node")
    lone = materialize(lone, "candidates")
    # repeated rows are one before the join and the exchange, so the sets need no exchange of their own
    picked = marked.where(bloom(lone, "_q_a")(F.col("_q_a"))).select("_q_a", "_q_b", "text").dropDuplicates(["_q_a", "_q_b"])
    picked = materialize(picked.join(lone, ["_q_a", "_q_b"]).select("grp", "node", "text"), "picked")  # two Python steps in one task would need twice the workers
    sets = materialize(picked.select("grp", "node", sets_column(F.col("text"), words).alias("shingles")), "sets")
    discard(picked)
    grids = sets.select(F.xxhash64(F.lit("grid"), "grp").alias("grid"), "node", set_fingerprint_column(F.col("shingles"), PRINT_WORDS).alias("words"))
    grids = materialize(grids, "fingerprints")
    near = components(near_links(grids, radius(similarity, 64 * PRINT_WORDS), radius(similarity, 64), TILE_ROWS, "grid"))
    discard(grids)
    # groups change from step to step; what meets them are sketches, and in the end the sets that are still in one
    drawn = materialize(sketched(sets.select("node", "shingles"), similarity), "drawn")
    even = components(sketch_links(drawn.join(near.withColumnRenamed("root", "grp"), "node"), similarity))
    discard(drawn)
    alike = sets.select("node", "shingles").where(bloom(even, "node")(F.col("node"))).join(even.withColumnRenamed("root", "grp"), "node")
    alike = materialize(alike.select("grp", "node", "shingles"), "alike")
    discard(sets)
    roots = components(similar_links(alike, similarity))
    discard(alike)
    # which row of each group stays
    rooted = nodes.join(roots, "node", "left").select("a", "b", "copies", "best", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    stay = rooted.groupBy("root").agg(F.min("best").alias("stay"), F.sum("copies").alias("n")).where("n > 1").select("root", "stay._q_a", "stay._q_b")
    stay = materialize(stay.select("root", F.col("_q_a").alias("sa"), F.col("_q_b").alias("sb")), "stay")
    told = prints.select("a", "b", "_q_a", "_q_b").join(rooted.join(stay, "root").select("a", "b", "sa", "sb"), ["a", "b"])
    told = materialize(told.select("_q_a", "_q_b", ((F.col("_q_a") == F.col("sa")) & (F.col("_q_b") == F.col("sb"))).alias("_q_stays")).distinct(), "told")
    for old in (prints, nodes, lone, rooted, stay):
        discard(old)
    # most texts are in no group: a filter of fixed size spares them the exchange, the join decides on the rest
    maybe = bloom(told, "_q_a")(F.col("_q_a"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.where(maybe).join(told, ["_q_a", "_q_b"], "left").where("_q_stays is null or _q_stays").dropDuplicates(["_q_a", "_q_b"])
    return marked.where(~maybe).select(*names).unionByName(rest.select(*names))
