"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) of longs to (node, root): each node that has a link to the least node that it can reach.

    Every round joins links with the least neighbour of each node, so a hub is handled by partial aggregation and by
    splitting the join, and path lengths shrink geometrically; rounds end when nothing changes.
    """
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: greater neighbours point to the least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's lesser neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, edges = edges, scratch.cut(joined.select("e.a", "e.b").where("a <> b").distinct())
        scratch.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
