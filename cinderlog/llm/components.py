"""Connected components of links, by alternating star contraction. Every round is written; none of it passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return hung.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges go from the larger node to the smaller one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``a, b`` (long) that is not the smallest of its component; ``root`` is the smallest.

    Loops and repeated links do no harm. Busy nodes are met by partial minima and by joins whose large partitions may be split.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = written(links, "links"), None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if not now[0] or tuple(now) == before:
            found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found.written_path = links.written_path
            return found
        before = tuple(now)
        large = written(_large_star(links), "large-star")
        links, used = written(_small_star(large), "small-star"), links
        discard(large, used)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
