"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns ``a`` and ``b``; returns (node, root), root the smallest node.

    Nodes without a link to another node are not returned. Rows with a null end and self links are
    ignored. Every round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Links and labels stay distributed. A hub is a hot join key; both
    sides of each join are plain exchanges, so adaptive execution splits it.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("v"), F.least("u", "w").alias("m")), "least")
        large = materialize(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        for old in (edges, least, large, low):
            discard(old)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _all_stars(edges: DataFrame) -> bool:
    """True if every node has one smaller neighbour at most, and none if it is one itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).where("ups > 1 or (ups = 1 and downs = 1)")
    return bad.agg(F.count("*")).first()[0] == 0
