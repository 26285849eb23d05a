"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one alone, which has none itself."""
    up = edges.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    down = edges.select(F.col("v").alias("n"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    node = up.union(down).groupBy("n").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return not node.where("ups > 1 OR ups > 0 AND downs > 0").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge but the roots: the smallest node of its component.

    edges: two long columns, in any direction, repeats and loops allowed, no nulls. Minima are pre-aggregated, and each
    round is a table in the shared folder; a hub's rows meet only in joins that adaptive execution can split.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
