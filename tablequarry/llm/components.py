"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge (columns ``a``, ``b``); a component's name is its smallest node.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Only rows of two numbers move, minima are taken
    before the shuffle, and a node's neighbours are never gathered; the number of rounds grows with
    the logarithm of the longest chain. The result is a stored table; the tables of the rounds are
    removed.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the neighbour itself also keeps its own way down
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    named = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = links.select(F.col("v").alias("node")).distinct().join(named, "node", "left_anti")
    out = stored(named.unionByName(roots.select("node", F.col("node").alias("component"))))
    discard(links)
    return out
