"""Indexes on disk: vectors and their leaves as Parquet, partitioned by tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.distance import check_metric


def save_index(vectors: DataFrame, leaves: DataFrame, metric: str, path: str) -> None:
    vectors.select("id", "features").write.mode("overwrite").parquet(f"{path}/vectors")
    leaves.select("id", "tree", "leaf").write.mode("overwrite").partitionBy("tree").parquet(f"{path}/leaves")
    vectors.sparkSession.range(1).select(F.lit(check_metric(metric)).alias("metric")).coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def search_index(spark: SparkSession, path: str, k: int = 150, max_iter: int = 1, metric: str | None = None) -> DataFrame:
    """Neighbours from a stored index: those that the search which stored it found. ValueError for another metric than its own."""
    from nearfold.operators.knn import refine

    stored = spark.read.json(f"{path}/settings").first().metric
    if metric is not None and check_metric(metric) != stored:
        raise ValueError(f"the index was built for {stored}")
    vectors = spark.read.parquet(f"{path}/vectors")
    leaves = spark.read.parquet(f"{path}/leaves").select("id", F.col("tree").cast("int").alias("tree"), "leaf")
    return refine(leaves, vectors, k, max_iter, stored)
