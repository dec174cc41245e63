"""Connected components of a graph of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for the nodes of links (a, b).

    Alternating star contraction: every node links its larger neighbours to its smallest one
    (large star), then its smaller ones (small star), until nothing changes; the number of
    rounds grows with the logarithm of the longest path. Each round is a written table, so a
    lost executor costs no earlier round. A node's links are only ever aggregated, not gathered.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.distinct(), "links")
    before = None
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbours and itself.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large")
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        links = stored(small.filter("a <> b").distinct(), "small")
        # Stars only are left when nothing moved: the table's digest stays as it was.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
