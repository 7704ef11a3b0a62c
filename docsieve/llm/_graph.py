"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.sum(F.xxhash64("v", "u") % 1_000_033).alias("g")).first()
    return r["n"], r["h"], r["g"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches.

    Each round hangs every neighbourhood on its smallest node. The smallest neighbours
    are stored before they are joined, so a node with very many edges meets them in a
    join that adaptive execution splits: it costs one row per edge. Rounds grow with
    the logarithm of the longest path. Tables between rounds are written to the shared
    folder, so a lost executor costs one round at most.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = stored(both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old, low, large, least)
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
