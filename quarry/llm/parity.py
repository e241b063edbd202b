"""Sketches of sets by parities of bins, which bound a Jaccard similarity from above.

The different elements of a set are dealt by hash into bins, and a bit tells whether a bin has an odd
number. An element that only one of two sets has flips one bit, so the bits differ in no more places than
the sets have elements apart. Sets of n and m elements with a similarity of s are at most
(n + m) (1 - s) / (1 + s) elements apart: what differs in more bits is not similar, whatever the sets hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, ship
from quarry.llm.simhash import tile_links

FIRST_BAND = 8  # sets of up to 2^8 elements have 2^8 bits, each band above twice as many of both
STEP = math.log(1.02)  # of the logarithm of the size, in the order of the tiles
TILE_BYTES = 1_000_000
TILE_ROWS = 128
PAIR_BYTES = 1 << 25  # of words compared at once


def band(size: int) -> int:
    """The smallest band that holds sets of ``size`` elements."""
    return max(FIRST_BAND, (max(size, 1) - 1).bit_length())


def parities(elements: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a power of two, 64 at least) parities of the bins, as 64-bit words."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(elements: np.ndarray, similarity: float) -> list[dict]:
    """For the set's own band and each band that holds larger sets it may be similar to: band, place in the
    order of sizes, and words (the size of the set, then its parities)."""
    n = len(elements)
    if not n:
        return []
    bands = range(band(n), band(math.floor(n / similarity + 1e-6)) + 1)
    return [{"band": k, "place": int(math.log(n) / STEP), "words": np.concatenate([[n], parities(elements, 1 << k)])} for k in bands]


def sketch_column(shingles, similarity: float):
    """array<struct<band, place, words>>: :func:`sketches` of a set of 64-bit hashes (binary)."""
    kind = pa.list_(pa.struct([("band", pa.int32()), ("place", pa.int32()), ("words", pa.list_(pa.int64()))]))

    @F.arrow_udf("array<struct<band:int,place:int,words:array<bigint>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([sketches(np.frombuffer(x, np.uint64), similarity) for x in a.to_pylist()], kind)

    return run(shingles)


def near(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix: the parities leave it open that the sets are similar. Rows are size, then words."""
    apart = (1 - similarity) / (1 + similarity)
    na, nb = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    width = a.shape[1] - 1
    out = np.empty((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 19) // max(1, len(b)))
    for s in range(0, len(a), step):
        x = a[s : s + step]
        most = np.floor((na[s : s + step, None] + nb[None, :]) * apart + 1e-6).astype(np.int32)
        differ = np.zeros(most.shape, dtype=np.int32)
        for w in range(1, 1 + width // 2):  # half of the words tells nearly all
            differ += np.bitwise_count(x[:, None, w] ^ b[None, :, w])
        out[s : s + step] = differ <= most
        i, j = np.nonzero(out[s : s + step])
        chunk = max(1, PAIR_BYTES // (8 * width))
        for c in range(0, len(i), chunk):
            p, q = i[c : c + chunk], j[c : c + chunk]
            bad = np.bitwise_count(x[p, 1:] ^ b[q, 1:]).sum(axis=1, dtype=np.int64) > most[p, q]
            out[s + p[bad], q[bad]] = False
    return out


def sketched(sets: DataFrame, similarity: float) -> DataFrame:
    """The columns of ``sets`` but for shingles (binary, 64-bit hashes), with a row for each sketch ``x`` of a set."""
    ship(sets.sparkSession)
    return sets.select(*[c for c in sets.columns if c != "shingles"], F.explode(sketch_column(F.col("shingles"), similarity)).alias("x"))


def sketch_links(rows: DataFrame, similarity: float, tile: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect all sets of a group with a Jaccard similarity of at least ``similarity``,
    and few others.

    ``rows`` has grp and node (long) and x (of :func:`sketched`). Sets of a group lie in order of their size;
    only tiles whose sizes allow the similarity are compared.
    """
    fits = F.floor(F.lit(TILE_BYTES) / (F.expr("shiftleft(1, x.band)") / 8 + 8))
    bucket = F.xxhash64(F.lit("sketch"), "grp", "x.band")
    rows = rows.select(bucket.alias("bucket"), "node", "x.place", F.greatest(F.lit(1), F.least(F.lit(tile), fits)).cast("int").alias("tile_rows"), "x.words")
    limit = math.ceil(-math.log(similarity) / STEP) + 1
    rows = materialize(rows, "sketches")
    return tile_links(rows, limit, lambda a, b: near(a, b, similarity))


def candidate_links(sets: DataFrame, similarity: float, tile: int = TILE_ROWS) -> DataFrame:
    """:func:`sketch_links` of ``sets``: grp and node (long, the node once) and shingles."""
    return sketch_links(sketched(sets, similarity), similarity, tile)
