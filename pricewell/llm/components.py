"""Connected components by alternating star contraction, staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.session import work_dir


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(u, component) for every node of ``edges`` (u long, v long): component is the least node reachable.

    Self-links and repeated links change nothing; no links give no rows. The number of rounds follows
    the logarithm of the size. Every round is written to the shared folder and read back.
    """
    spark = edges.sparkSession
    folder = folder or work_dir(spark, "components")
    reader = spark.read.schema("u long, v long")
    edges.select("u", "v").where("u != v").distinct().write.parquet(f"{folder}/0")
    seen, n = None, 0
    while True:
        now = reader.parquet(f"{folder}/{n}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, n = state, n + 1
        _small_star(_large_star(now)).write.parquet(f"{folder}/{n}")
    return now.select("u", F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
