"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def connected_components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(id, component) of every end of `edges` (a, b): component is the smallest id that links reach.

    most: a bound of the edges, where one is known.

    Null ends and loops are ignored, repeated edges change nothing, no edges give no rows. Every round only
    groups by a node with min() and joins that minimum back, so a hub of any degree is summed before the shuffle
    and its rows are split by the skew join; each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut(e, "cc", most), None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = cut(small.union(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc", 2 * state[0]), e
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
