"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c) for every vertex v of ``edges`` (a, b; not null): c is the smallest vertex reachable.

    Every round points each vertex's larger neighbours at its smallest one, then its smaller
    neighbours, until nothing changes; links stay at most as many as at the start, and a vertex
    with many links only takes part in minima and joins, both of which Spark can split.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, k, old = scratch.keep(links, f"{name}-0"), 0, None
    while True:
        k += 1
        # links have a > b: seen from both ends, each vertex's smallest neighbour or itself
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                               F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        links = scratch.keep(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(state) == old:
            break
        old = tuple(state)
    return links.select(F.col("a").alias("v"), F.col("b").alias("c")).union(links.select(F.col("b").alias("v"), F.col("b").alias("c"))).distinct()
