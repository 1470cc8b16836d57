"""Connected components over a table of links, by alternating large and small stars.

Every step is an aggregation and a join; links are stored between rounds. The links of one node
may be many: they are only ever summed up to a minimum or joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).withColumn("least", F.least("least", "a"))
    return (both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these neighbours."""
    down = links.filter(F.col("b") < F.col("a"))
    least = _least_neighbour(down)
    moved = (down.join(least, "a").filter(F.col("b") != F.col("least"))
             .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). Returns node, component (its smallest node); only nodes with links.

    Links to oneself and nulls are ignored; direction and repetition do not matter. No links give
    an empty table.
    """
    state = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        last, state = state, stored(_small_star(_large_star(state).distinct()).distinct(), "links")
        release(last)
    roots = state.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def joined_up(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: every group counts as one node, so the links inside groups are not
    walked again. ``groups`` as from ``components``; returns the same columns."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    roots = components(between)
    moved = roots.select(F.col("node").alias("component"), F.col("component").alias("_root"))
    fresh = roots.join(groups.select("node"), "node", "left_anti")
    return (groups.join(moved, "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
            .unionByName(fresh))
