"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minimums and two joins over the edge table, written to the
shared folder; nothing about single nodes reaches the driver but a count and a checksum.
Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, new_folder, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, label)``, label the smallest node reachable.

    Nodes without an edge are absent. Self loops are ignored and rows with a null end drop out.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")
    current = stage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "round-0",
        folder,
    )
    before = _state(current)
    for i in range(1, max_rounds + 1):
        if not before[0]:
            break
        following = stage(_small_star(_large_star(current).distinct()).distinct(), f"round-{i}", folder)
        after = _state(following)
        if i > 1:
            drop_folder(spark, f"{folder}/round-{i - 1}")
        current = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
