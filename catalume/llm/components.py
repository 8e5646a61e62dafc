"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps are grouped minima and joins, so no component is gathered in a task; each step's links are written to the shared
folder, which cuts lineage. The number of rounds grows with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node that links reach) for all nodes of ``links`` (a, b: longs); loops are ignored."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = both if large else both.where("b < a")
        low = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_n"), F.least("a", "m").alias("m"))
        out = near.join(low, F.col("a") == F.col("_n"))
        if large:  # larger neighbours hang on the smallest of the neighbourhood
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        own = low.select(F.col("_n").alias("a"), F.col("m").alias("b"))
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a > b").distinct()

    def mark(edges: DataFrame) -> tuple:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(seen)

    edges = scratch.save(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    while before[0]:
        large = scratch.save(star(edges, True), "large")
        small = scratch.save(star(large, False), "small")
        scratch.drop(edges, large)
        edges, now = small, mark(small)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
