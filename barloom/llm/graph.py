"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barloom.llm.common import discard
from barloom.session import staged


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Alternating star contraction (Kiveris et al., 2014): every node points its
    larger neighbours, then its smaller ones, at the smallest it knows. Minima
    are aggregated before the shuffle, so a centre with many neighbours does
    not gather in one task. Each round is a written table. Fails rather than
    return unfinished components.
    """
    current, before = _written(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(rounds):
        if before[0] == 0:
            break
        last = current
        current, now = _written(_small_star(_large_star(last)))
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a sum of hashes taken while they are written."""
    seen = Observation()
    # the sum is a decimal: no overflow, no order
    table = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total")))
    return table, (seen.get["n"], seen.get["total"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
