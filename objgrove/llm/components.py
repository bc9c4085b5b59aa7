"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of one type to (node, component), the component named by its smallest node.

    Alternating star rounds: every node's larger neighbours are linked to its smallest one, then the same with its
    smaller neighbours, until nothing changes. The number of edges never grows, and rounds follow the logarithm of the
    components' size. Lineage is cut each round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, state()
    while now != before and now[0]:
        low = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("at"), F.least("m", "u").alias("m"))
        large = e.join(low, e["v"] == low["at"]).select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
