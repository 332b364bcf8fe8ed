"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import remove, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link; a written table.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then
    its smaller ones, to the smallest. Rounds grow with the logarithm of the number of nodes;
    a round's tables have at most as many rows as there are links, and the minimum of each
    node is combined before its shuffle. Every round is a written table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = written(links.select(high.alias("u"), low.alias("v")).filter("u > v").distinct(), "links")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        out = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        following = written(out, "links")
        remove(edges)
        edges = following
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    remove(edges)
    return out
