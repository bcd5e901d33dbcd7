"""Connected components of a table of links, by alternating stars, without gathering any node's links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node with a link: comp is the smallest node reachable.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest in sight;
    the number of rounds grows with the logarithm of the longest path.  Minima are combined before the
    shuffle, the join back to links splits under skew, and every round is written to the shared folder.
    Self links name a node without joining it to others; null ends are dropped; no links, no rows."""
    stars = common.keep(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        # large star: larger neighbours of u, and u itself, to the smallest neighbour
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.where("u = m").select("u", F.col("m").alias("v"))
        large = large.union(kept).union(stars.where("u = v")).distinct()
        # small star: smaller neighbours of u, and u itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, stars = stars, common.keep(small.where("u >= v").distinct(), "stars")
        common.discard(before)
        # done once every link ends at a node that has no smaller one, and no node has two such ends
        ends = F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        roles = stars.where("u > v").select(F.inline(ends)).groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if roles.where("down > 1 or (down = 1 and up = 1)").isEmpty():
            break
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
