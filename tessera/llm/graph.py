"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u with the least node among itself and its neighbours: map-side combined, so hubs cost no more than others."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def components(edges: DataFrame) -> DataFrame:
    """Nodes of the edges (u, v) with the least node of their component: (node, root).

    Each round is two joins on aggregated sides, written to the shared folder; hubs
    are split by adaptive skew joins. It ends when a round changes nothing, after a
    number of rounds logarithmic in the size of the largest component. Edges with a
    null end are left out. No edges: no rows.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return checkpointed(e.where("u <> v").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = tidy(edges.select("u", "v"))
    before = None
    while (seen := mark(now)) != before:
        before = seen
        if not seen[0]:
            break
        now = tidy(_small_star(_large_star(now)))
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
