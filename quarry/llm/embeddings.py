"""Embedding near-dedup as an exact metric range join with pivots.

Every vector belongs to the cell of its nearest pivot. By the triangle inequality it is also sent, as a
guest, to the cells that can hold a vector within the radius: those whose border (the hyperplane between
the two pivots) and whose farthest member are near enough. Of two cells only the one of higher number
receives guests, so each pair is met once. Cells join independently; large ones in blocks. Within a cell,
distances to a few orthonormal pivot directions bound the cosine from above before the rest is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read, ship, tasks
from quarry.llm.components import components
from quarry.llm.simhash import _forest

COSINE = 0.95
PIVOTS = (8, 4096)  # least and most; between them one for each CELL vectors
CELL = 16384  # vectors for each pivot, and of a block of a large cell
LEADING = 16  # pivot directions that bound the cosine
SEED = 11
_SLACK = 1e-4  # for single precision; whatever passes is computed again in double precision


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False)), len(column))


def leading(pivots: np.ndarray, dim: int, k: int = LEADING) -> np.ndarray:
    """Orthonormal directions (dim x k at most) spanned by pivots, filled up with fixed random ones."""
    more = np.random.default_rng(SEED).standard_normal((min(k, dim), dim))
    q, _ = np.linalg.qr(np.vstack([pivots[:k], more])[: min(k, dim)].T)
    return q


def bounded(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Coordinates along the directions and the length of the rest: their inner products bound the
    cosines from above (single precision)."""
    y = x @ q
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
    return np.hstack([y, rest[:, None]]).astype(np.float32)


def close(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix: cosine of unit rows of ``a`` and ``b`` at least ``least``, in double precision."""
    near = pa_ @ pb.T >= np.float32(least - _SLACK)
    i, j = np.nonzero(near)
    if len(i) > near.size // 8:
        return near & (a @ b.T >= least)
    for s in range(0, len(i), 1 << 16):
        bad = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]) < least
        near[i[s : s + (1 << 16)][bad], j[s : s + (1 << 16)][bad]] = False
    return near


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """node, embedding, home cell and cosine to its pivot, of vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            dots = _matrix(rb.column(1)) @ pivots.T
            home = dots.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), pa.array(home.astype(np.int32)), pa.array(dots.max(axis=1))], ["node", "embedding", "copies", "home", "dot"])

    return rows.mapInArrow(run, "node bigint, embedding array<double>, copies bigint, home int, dot double")


def _guests(homed: DataFrame, pivots: np.ndarray, farthest: np.ndarray, blocks: np.ndarray, least: float) -> DataFrame:
    """Each row once for every (cell, block) in which it is a member or a guest."""
    radius = np.sqrt(2 - 2 * least)
    many = np.asarray(blocks, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                rb = whole.slice(s, 512)
                dots = _matrix(rb.column(1)) @ pivots.T
                node, home = rb.column(0).to_numpy(), rb.column(3).to_numpy()
                own = dots[np.arange(len(home)), home]
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots[home] @ pivots.T))
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = np.where(apart > 0, (own[:, None] - dots) / apart, 0.0)
                reach = np.sqrt(np.maximum(0.0, 2 - 2 * dots)) <= farthest[None, :] + radius + 1e-9
                guest = (border <= radius + 1e-9) & reach & (np.arange(dots.shape[1])[None, :] > home[:, None]) & (many[None, :] > 0)
                block = (node.view(np.uint64) % many[home].astype(np.uint64)).astype(np.int64)
                take, cell, part, kind = [np.arange(len(home))], [home.astype(np.int64)], [block], [np.zeros(len(home), np.int8)]
                for b in range(int(many.max())):
                    later = np.flatnonzero((b < many[home]) & (b < block))  # members meet each lower block once
                    i, c = np.nonzero(guest & (b < many)[None, :])
                    take += [later, i]
                    cell += [home[later].astype(np.int64), c]
                    part += [np.full(len(later) + len(i), b)]
                    kind += [np.ones(len(later) + len(i), np.int8)]
                t = np.concatenate(take)
                for s2 in range(0, len(t), 4096):
                    u = pa.array(t[s2 : s2 + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [rb.column(0).take(u), rb.column(1).take(u), rb.column(2).take(u), *(pa.array(np.concatenate(x)[s2 : s2 + 4096].astype(np.int32)) for x in (cell, part, kind))],
                        ["node", "embedding", "copies", "cell", "part", "guest"],
                    )

    return homed.mapInArrow(run, "node bigint, embedding array<double>, copies bigint, cell int, part int, guest int")


def _join(dealt: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """For each cell: how many vectors each row is linked with, and links that connect what is linked."""
    q = leading(pivots, pivots.shape[1])

    def out(ids, n, a, b):
        k = len(ids)
        first, second = np.concatenate([ids, a]), np.concatenate([np.zeros(k, np.int64), b])
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), pa.array(second), pa.array(np.arange(len(first)) >= k)], ["a", "n", "b", "link"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, whole = None, [], None
        for rb in batches:
            cell, part, guest = (rb.column(i).to_numpy() for i in (3, 4, 5))
            same = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(guest) != 0)) + 1
            for s, e in zip([0, *same], [*same, rb.num_rows], strict=True):
                if s == e:
                    continue
                if (cell[s], part[s]) != key:
                    yield from inner(members, whole)
                    key, members, whole = (cell[s], part[s]), [], None
                run_ = rb.slice(s, e - s)
                x = _matrix(run_.column(1))
                now = run_.column(0).to_numpy(), run_.column(2).to_numpy(), x, bounded(x, q)
                if guest[s] == 0:
                    members.append(now)
                    continue
                if whole is None:
                    yield from inner(members, None)
                    whole = [np.concatenate(c) for c in zip(*members, strict=True)] if members else []
                    members = []
                if whole:
                    yield from pairs(whole, now, False)
        yield from inner(members, whole)

    def inner(members, whole):
        if members and whole is None:
            m = [np.concatenate(c) for c in zip(*members, strict=True)]
            yield from pairs(m, m, True)

    def pairs(one, two, same):
        step = max(1, (1 << 22) // len(two[0]))  # the matrix of a step stays small
        for s in range(0, len(one[0]), step):
            a = [c[s : s + step] for c in one]
            near = close(a[2], two[2], a[3], two[3], least)
            if same:
                near &= np.arange(len(two[0]))[None, :] > np.arange(s, s + len(a[0]))[:, None]
            if not near.any():
                continue
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            n = np.concatenate([near[rows] @ two[1], a[1] @ near[:, cols]])
            x, y = _forest(near, a[0], two[0])
            yield out(np.concatenate([a[0][rows], two[0][cols]]), n.astype(np.int64), x, y)

    return dealt.mapInArrow(run, "a bigint, n bigint, b bigint, link boolean")


def near_vectors(table: DataFrame, least: float = COSINE, pivots: tuple[int, int] = PIVOTS, cell: int = CELL) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``table`` (vec_id, embedding).

    n_links is the number of other vectors with a cosine of at least ``least`` in double precision,
    component_id the smallest vec_id that links reach, itself included. Null, empty and zero vectors, and
    those with a null, infinite or undefined component link with nothing; vectors of different dimensions
    don't either. Equal vectors are linked, compared once and counted as often as they occur, so that
    copies don't multiply the work. Vectors are told apart by 128 bits of hash of their content. Repeated
    rows each count; a null vec_id is not the smallest unless there is no other. Other columns are
    ignored. The pivots are a bounded sample (``pivots``: least and most); everything else reads all rows.
    """
    spark = table.sparkSession
    ship(spark)
    vector = F.transform(F.col("embedding"), lambda v: v.cast("double") + 0.0)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    length = F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)
    rows = table.select("vec_id", vector.alias("v"))
    rows = rows.withColumn("good", F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & (length > 0) & (length < float("inf")), F.lit(False)))
    hashes = [F.when(F.col("good"), F.xxhash64(F.lit(i), "v")).alias(f"h{i}") for i in range(2)]
    rows = materialize(rows.select("vec_id", F.when(F.col("good"), F.col("v")).alias("v"), *hashes), "vectors")
    nodes = rows.where("h0 is not null").groupBy("h0", "h1").agg(F.first("v").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    counts = {r["d"]: r["n"] for r in nodes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = []
    for d, n in sorted(counts.items()):
        part = nodes.where(F.size("embedding") == d).select("node", "embedding", "copies")
        k = int(min(max(n // cell, pivots[0]), pivots[1], n))
        chosen = part.orderBy(F.xxhash64(F.lit(SEED), "embedding"), "node").limit(k).select("embedding").collect()
        at = _unit(np.array([r[0] for r in chosen], dtype=np.float64), k)
        homed = materialize(_assign(part, at), "homed")
        far, many = np.zeros(k), np.zeros(k)
        for r in homed.groupBy("home").agg(F.min("dot").alias("dot"), F.count("*").alias("n")).collect():
            far[r["home"]], many[r["home"]] = np.sqrt(max(0.0, 2 - 2 * r["dot"])), -(-r["n"] // cell)
        dealt = _guests(homed, at, far, many, least).repartition(tasks(spark), "cell", "part").sortWithinPartitions("cell", "part", "guest")
        found.append(_join(dealt, at, least))
    if found:
        all_found = found[0]
        for f in found[1:]:
            all_found = all_found.unionByName(f)
        all_found = materialize(all_found, "found")
        links = all_found.where("not link").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        roots = components(all_found.where("link").select("a", "b"))
    else:
        links, roots = spark.createDataFrame([], "node bigint, others bigint"), spark.createDataFrame([], "node bigint, root bigint")
    rooted = nodes.join(links, "node", "left").join(roots, "node", "left")
    rooted = materialize(rooted.select("h0", "h1", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    result = materialize(rooted.join(smallest, "root").select("h0", "h1", "n_links", "component_id"), "result")
    out = rows.select("vec_id", "h0", "h1").join(result, ["h0", "h1"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings, as :func:`near_vectors` says."""
    out = near_vectors(read(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(r.reached) AS component_id, v.vec_id = min(r.reached) AS kept
FROM v JOIN r ON v.vec_id = r.vec_id LEFT JOIN n ON v.vec_id = n.a
GROUP BY v.vec_id
"""
