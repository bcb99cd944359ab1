"""Connected components by alternating large-star and small-star steps.

Each step is one hash aggregation and one join, edges stay distributed, and the edge table is written to the shared
folder after every round, so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.scratch import discard, new_path, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its closed neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that can be reached.

    Edges are undirected; loops, repeats and edges with a null end are left out. An empty table gives an empty one.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    loops = clean.select(F.col("u").alias("node")).unionByName(clean.select(F.col("v").alias("node"))).distinct()
    path = new_path(spark, "edges")
    now = written(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    state = None
    for _ in range(max_rounds):
        after = new_path(spark, "edges")
        step = written(_small_star(_large_star(now)), "edges", after)
        # xor of hashes: the edge set stands still when count and checksum do
        seen = step.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        discard(spark, path)
        path, now = after, step
        if state == (seen.n, seen.h):
            break
        state = (seen.n, seen.h)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )
