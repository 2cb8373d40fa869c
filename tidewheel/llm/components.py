"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, saved


def _towards_least(edges: DataFrame, onlybelow: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself.

    Below: neighbours under the node, and the node; else those above it.
    """
    if onlybelow:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = sides.join(least, "u")
    if onlybelow:
        new = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        new = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return new.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of ``links`` (columns ``a``, ``b``); a root is its component's least node.

    Each round is two groupings with sums in the tasks, so a node with very
    many neighbours is never gathered. The number of rounds grows with the
    logarithm of the number of nodes. Links of a node to itself do not count.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
        "links",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while True:
        old, edges = edges, saved(_towards_least(_towards_least(edges, False), True), "stars")
        now = mark(edges)
        discard(old)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
