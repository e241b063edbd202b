"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints lie in order of their population count and are cut into tiles; tiles are compared with each
other. What differs in at most the radius of bits differs in its count by no more, so a row is sent only to
the tiles whose counts are that near: all other tile pairs are skipped before anything is shuffled.

With a radius under four the grid lies within a partition that loses no pair: fingerprints within the radius
agree exactly on at least ``4 - radius`` of four 16-bit lanes, so each choice of lanes gives buckets with a
grid of their own. With a larger radius there is one grid, whose work is quadratic in the number of
different fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, read, ship, tasks, texts_of
from quarry.llm.components import components
from quarry.llm.words import fingerprint, signs

TILE = 1024  # fingerprints of a tile
STRIP = 512  # rows of a tile that are compared with another at once
WIDE = 1 << 14  # fingerprints of a tile where all are compared


def fingerprint_column(text, words: int = 3, seed: int = 42, lanes: int = 1):
    """Array of ``lanes`` longs: the SimHash words of each whole text (null or no words: zeros)."""

    @F.arrow_udf("array<bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            prints = [fingerprint(t, words, seed, lanes) for part in texts_of(a) for t in part]
            flat = np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * lanes), pa.array(flat))

    return run(text)


def set_fingerprint_column(hashes, lanes: int = 1):
    """Array of ``lanes`` longs: the SimHash words of each set of 64-bit hashes (binary; empty: zeros)."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            sets = (np.frombuffer(x, np.uint64) for x in a.to_pylist())
            yield pa.array([signs([s] if len(s) else [], lanes).view(np.int64) for s in sets], pa.list_(pa.int64()))

    return run(hashes)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left id, right id) that connect what the matrix ``near`` connects: all of them if they
    are few, else one for each row and column, to the smallest member it reaches within the tile."""
    i, j = np.nonzero(near)
    if len(i) <= 2 * (len(left) + len(right)):
        return left[i], right[j]
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    m = near[np.ix_(rows, cols)]
    far = np.iinfo(np.int64).max
    a, b = left[rows].copy(), np.minimum(right[cols], np.where(m, left[rows][:, None], far).min(axis=0))
    while True:
        a2 = np.minimum(a, np.where(m, b[None, :], far).min(axis=1))
        b2 = np.minimum(b, np.where(m, a2[:, None], far).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return np.concatenate([left[rows], right[cols]]), np.concatenate([a2, b2])
        a, b = a2, b2


def _near(a: np.ndarray, b: np.ndarray, radius: int, first: int | None) -> np.ndarray:
    """Boolean matrix: the rows of ``a`` and ``b`` (n x lanes words) differ in ``radius`` bits or fewer.

    ``first`` bounds the bits that differ in the first word alone; only what passes is compared whole.
    """
    out = np.empty((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 19) // max(1, len(b)))
    for s in range(0, len(a), step):
        x = a[s : s + step]
        near = np.bitwise_count(x[:, None, 0] ^ b[None, :, 0]) <= (radius if first is None else min(first, radius))
        if a.shape[1] > 1:
            i, j = np.nonzero(near)
            bad = np.bitwise_count(x[i] ^ b[j]).sum(axis=1) > radius
            near[i[bad], j[bad]] = False
        out[s : s + step] = near
    return out


def _links_schema() -> str:
    return "a bigint, b bigint"


def _batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])


def _lanes(prints: DataFrame, radius: int) -> DataFrame:
    """bucket and fp of one-word fingerprints (column ``fp``), once for each choice of ``4 - radius`` lanes."""
    lane = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = []
    for n, chosen in enumerate(combinations(range(4), 4 - radius)):
        if len(chosen) == 4:
            keys.append(F.col("fp"))
            continue
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 16).bitwiseOR(lane[i])
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def tile_links(rows: DataFrame, limit: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray], mix: int = 0) -> DataFrame:
    """Links (a, b) between rows of a bucket that pass ``test``, found by comparing tiles.

    ``rows`` has bucket and node (long), place (int), tile_rows (int, one value a bucket) and words
    (array<bigint>, as many for all of a bucket). Only rows whose places differ by ``limit`` or less are sure
    to be compared. ``test`` gives the boolean matrix of two arrays of words. Within a tile pair with very
    many links only a spanning set of them is returned. Groups of up to ``mix`` rows are compared together
    (what passes across them is a link as well).

    A bucket with more rows than a tile is cut in order of place. The places of a bucket are few, so its plan
    is; it tells each place the tiles within the limit, and a row is sent to the pairs of its tile with those
    alone. Every tile pair is a unit of its own, so a hot bucket is dealt out evenly.
    """
    spark = rows.sparkSession
    heavy = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.first("tile_rows").alias("t")).where("n > t")
    heavy = materialize(heavy.select("bucket", "t"), "heavy")
    none = F.lit(0).cast("long")
    if heavy.isEmpty():
        dealt = rows.select("bucket", none.alias("p"), none.alias("q"), none.alias("tile"), "node", "words")
    else:
        per = rows.select("bucket", "place").join(heavy, "bucket").groupBy("bucket", "place").agg(F.count("*").alias("n"), F.first("t").alias("t"))
        by = Window.partitionBy("bucket").orderBy("place")
        upto = lambda x: F.coalesce(F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, x)), none)
        plan = per.select("bucket", "place", "n", "t", upto(-1).alias("s"), F.floor(upto(-limit - 1) / F.col("t")).alias("low"), F.floor((upto(limit) - 1) / F.col("t")).alias("high"))
        plan = materialize(plan, "plan")
        share = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / float(1 << 30)
        tile = F.coalesce(F.floor((F.col("s") + F.floor(share * F.col("n"))) / F.col("t")), none)
        dealt = rows.join(plan, ["bucket", "place"], "left").select("bucket", "node", "words", tile.alias("tile"), F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"))
        dealt = dealt.select("bucket", "tile", "node", "words", F.explode(F.sequence("low", "high")).alias("other"))
        dealt = dealt.select("bucket", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "words")
    dealt = dealt.repartition(tasks(spark), "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "tile")

    def whole(nodes: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(nodes), STRIP):
            near = test(words[s : s + STRIP], words[s:])
            near &= np.arange(near.shape[1])[None, :] > np.arange(len(near))[:, None]
            x, y = _forest(near, nodes[s : s + STRIP], nodes[s:])
            if len(x):
                yield _batch([x], [y])

    def cross(nodes: np.ndarray, words: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        for s in range(0, len(one) if len(two) else 0, STRIP):
            own = one[s : s + STRIP]
            x, y = _forest(test(words[own], words[two]), nodes[own], nodes[two])
            if len(x):
                yield _batch([x], [y])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, loose, n = None, [], [], 0

        def mixed() -> Iterator[pa.RecordBatch]:
            if loose:
                yield from whole(np.concatenate([x[1] for x in loose]), np.concatenate([x[2] for x in loose]))

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal loose, n
            tile, nodes, words = (np.concatenate([x[i] for x in held]) for i in range(3))
            if len(nodes) < 2:
                return
            if len(nodes) <= mix:
                loose, n = [*loose, (tile, nodes, words)], n + len(nodes)
                if n >= mix:
                    yield from mixed()
                    loose, n = [], 0
            elif key[1] == key[2]:
                yield from whole(nodes, words)
            else:
                yield from cross(nodes, words, tile == key[1])

        for rb in batches:
            if not rb.num_rows:
                continue
            bucket, p, q, tile, node = (rb.column(i).to_numpy() for i in range(5))
            flat = rb.column(5).flatten().to_numpy().view(np.uint64)
            start = np.concatenate([[0], np.cumsum(pc.list_value_length(rb.column(5)).to_numpy())])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1, [rb.num_rows]])
            keep = np.diff(edges) > 1  # a row alone has nothing to be compared with, unless its group goes on
            keep[[0, -1]] = True
            for s, e in zip(edges[:-1][keep], edges[1:][keep], strict=True):
                now = (bucket[s], p[s], q[s])
                if now != key:
                    if held:
                        yield from closed()
                    key, held = now, []
                held.append((tile[s:e], node[s:e], flat[start[s] : start[e]].reshape(e - s, -1)))
        if held:
            yield from closed()
        yield from mixed()

    return dealt.mapInArrow(compare, _links_schema())


def near_links(prints: DataFrame, radius: int = 2, first: int | None = None, tile: int | None = None, within: str | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints which differ in ``radius`` bits or fewer.

    ``prints`` has one row for each different fingerprint: ``node`` (long) and ``words``
    (array<bigint>, population counts are those of its first word). ``first`` bounds the bits in which the
    first words differ. Within a tile pair with very many links only a spanning set of them is returned, so
    that the components are those of all links but a large group does not give all its pairs. With ``within``,
    a column of longs, only fingerprints of one value are compared, in a grid for each value.
    """
    if within:
        rows = prints.select(F.col(within).alias("bucket"), "node", F.bit_count(F.element_at("words", 1)).alias("place"), F.lit(tile or TILE).alias("tile_rows"), "words")
        return tile_links(rows, radius if first is None else min(first, radius), lambda a, b: _near(a, b, radius, first))
    lanes = prints.select(F.size("words").alias("n")).first()
    if lanes and lanes["n"] == 1 and radius < 4:
        rows = _lanes(prints.select(F.element_at("words", 1).alias("fp")).distinct(), radius)
        rows = rows.select("bucket", F.col("fp").alias("node"), F.bit_count("fp").alias("place"), F.lit(tile or TILE).alias("tile_rows"), F.array("fp").alias("words"))
        return tile_links(rows, radius, lambda a, b: _near(a, b, radius, None), mix=tile or TILE)
    rows = prints.select(F.lit(0).cast("long").alias("bucket"), "node", F.bit_count(F.element_at("words", 1)).alias("place"), F.lit(tile or WIDE).alias("tile_rows"), "words")
    return tile_links(rows, radius if first is None else min(first, radius), lambda a, b: _near(a, b, radius, first))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, lanes: int = 1, first: int | None = None, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Returns doc_id, the columns named in ``keep``, words (array<bigint>), component (long: a number of the
    component) and component_id: the smallest doc_id that links reach, itself included.

    Null and blank texts have the fingerprint zero and are linked like any other. Rows with equal
    fingerprints are always linked; repeated rows each get a row. A null doc_id is never the smallest
    unless the component has no other. An empty table gives an empty table. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", *keep, fingerprint_column(F.col("text"), words, seed, lanes).alias("words"))
    rows = materialize(rows.withColumn("node", F.element_at("words", 1) if lanes == 1 else F.xxhash64("words")), "prints")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")), "nodes")
    found = components(near_links(nodes, radius, first))
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    labels = materialize(rooted.join(smallest, "root").select("node", F.col("root").alias("component"), "component_id"), "labels")
    return rows.join(labels, "node").select("doc_id", *keep, "words", "component", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of documents.

    Null, empty and blank texts have the fingerprint zero and are linked like any other; whole texts count,
    however long. Equal fingerprints are linked, repeated rows each give a row, an empty table gives none, and
    other columns are ignored.
    """
    out = near_duplicates(read(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex(F.element_at("words", 1)), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id")
