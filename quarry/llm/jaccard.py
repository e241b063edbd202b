"""Exact Jaccard similarity of word shingles within groups of candidates, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, ship, tasks, texts_of
from quarry.llm.simhash import _batch, _forest
from quarry.llm.words import run_codes

ROWS = 48  # texts of a block; a unit of work is two of them
BYTES = 1_000_000  # of shingle hashes of a block
_WIDE = 1 << 13  # shingles counted at once


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted different 64-bit codes of the runs of ``k`` words."""
    parts = list(run_codes(text or b"", k))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def sets_column(text, k: int):
    """The set of shingles of each whole text (binary)."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([shingle_set(t, k).tobytes() for part in texts_of(a) for t in part], pa.binary())

    return run(text)


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of the sets at least ``least``; two empty sets are equal."""
    na, nb = (np.array([len(s) for s in x]) for x in (a, b))
    every, at = np.unique(np.concatenate([*a, *b]) if len(a) + len(b) else np.empty(0, np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]).astype(np.int64))
    shared = np.zeros((len(a), len(b)), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for s in range(0, len(every), _WIDE):
        lo, hi = np.searchsorted(at, (s, s + _WIDE))
        m = np.zeros((len(a) + len(b), min(_WIDE, len(every) - s)), dtype=np.float32)
        m[row[lo:hi], at[lo:hi] - s] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    union = na[:, None] + nb[None, :] - shared
    return (shared >= least * union - 1e-9) & ((shared > 0) | (union == 0))


def similar_links(nodes: DataFrame, least: float, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """Links (a, b) that connect all pairs of a group with a similarity of at least ``least``.

    ``nodes`` has grp (long), node (long, once in a group) and shingles (binary). Large groups are cut
    into blocks of bounded rows and bytes, and every two blocks meet in a task of their own.
    """
    ship(nodes.sparkSession)
    per = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("size")).where("n > 1")
    per = materialize(per.select("grp", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("size") / size)).cast("int").alias("parts")), "groups")
    dealt = nodes.join(per, "grp").withColumn("part", F.pmod(F.xxhash64("node", "grp"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("grp", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "shingles")
    dealt = dealt.repartition(tasks(nodes.sparkSession), "grp", "p", "q").sortWithinPartitions("grp", "p", "q", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            if not held:
                return
            one = [(n, s) for part, n, s in held if part == key[1]]
            two = one if key[1] == key[2] else [(n, s) for part, n, s in held if part == key[2]]
            if not one or not two:
                return
            near = similar([s for _, s in one], [s for _, s in two], least)
            if key[1] == key[2]:
                near = np.triu(near, 1)
            a, b = _forest(near, *(np.array([n for n, _ in x], dtype=np.int64) for x in (one, two)))
            if len(a):
                yield _batch([a], [b])

        for rb in batches:
            for s in range(0, rb.num_rows, 128):
                cols = [rb.column(i).slice(s, 128).to_pylist() for i in range(6)]
                for grp, p, q, part, node, data in zip(*cols, strict=True):
                    if (grp, p, q) != key:
                        yield from done()
                        key, held = (grp, p, q), []
                    held.append((part, node, np.frombuffer(data, np.uint64)))
        yield from done()

    return dealt.mapInArrow(compare, "a bigint, b bigint")
