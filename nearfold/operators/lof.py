"""Local outlier factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.dbscan import graph_of


def local_outlier_factor(edges) -> DataFrame:
    """(id, lof): mean local reachability density of the neighbours over one's own; null where it is undefined, as among copies. edges may be a Layout."""
    edges, _ = graph_of(edges, None)
    reach = edges.groupBy("src").agg(F.max("dist").alias("kdist"))
    near = edges.join(reach.select(F.col("src").alias("dst"), "kdist"), "dst")
    density = near.groupBy("src").agg(F.try_divide(F.lit(1.0), F.avg(F.greatest("kdist", "dist"))).alias("lrd"))
    around = edges.join(density.select(F.col("src").alias("dst"), F.col("lrd").alias("theirs")), "dst").groupBy("src").agg(F.avg("theirs").alias("theirs"))
    return density.join(around, "src").select(F.col("src").alias("id"), F.try_divide(F.col("theirs"), F.col("lrd")).alias("lof"))
