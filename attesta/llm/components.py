"""Connected components of a link table by alternating stars, without collecting links or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    ).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); root is the least node of its component.

    Each round replaces links by links to the least neighbour (large star, then small star) until
    nothing changes; every round is written to the shared folder. Nulls and self links are
    ignored; no links give no rows. Per-node minima are pre-aggregated, joins only look them up, so
    a node with very many links is no more than a skewed join, which AQE splits.
    """
    links = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        links = written(_small_star(_large_star(links)).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
