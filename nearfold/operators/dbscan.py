"""DBSCAN over a neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.components import connected_components
from nearfold.operators.edges import undirected
from nearfold.operators.ordering import numbered
from nearfold.scratch import written


def graph_of(edges, ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(edges, ids) of a neighbour graph or of a Layout that kept its edges; without ids, the vertices that have edges. ValueError for a Layout without edges."""
    if hasattr(edges, "coords"):
        if edges.edges is None:
            raise ValueError("the layout was made without keeping its edges")
        ids = edges.coords.select("id") if ids is None else ids
        edges = edges.edges
    if ids is None:
        ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return edges, ids


def check_neighbors(edges: DataFrame, least: int) -> int:
    """The number of neighbours a vertex has at most; ValueError if it is less than `least`."""
    k = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    if k < least:
        raise ValueError("Insufficient neighbors.")
    return k


def core_points(edges: DataFrame, eps: float, min_pts: int) -> tuple[DataFrame, DataFrame]:
    """(region edges, core ids): edges of either direction shorter than eps, and points that have min_pts in their region, themselves included."""
    region = undirected(edges).filter(F.col("dist") < eps)
    return region, region.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pts - 1).select(F.col("src").alias("id"))


def dbscan(edges, ids: DataFrame | None = None, eps: float = float("inf"), min_pts: int | None = None) -> DataFrame:
    """(id, cluster): clusters are numbered from 1 by their smallest core point, 0 is noise. edges may be a Layout.

    Clusters are the components of edges between core points; a border point belongs to the first of its core neighbours' clusters.
    """
    edges, ids = graph_of(edges, ids)
    k = check_neighbors(edges, min_pts or 1)
    region, core = core_points(edges, eps, min_pts or k - 1)
    region, core = written(region, "region"), written(core, "core")
    inner = region.join(core.select(F.col("id").alias("src")), "src").join(core.select(F.col("id").alias("dst")), "dst")
    linked = connected_components(inner.filter("src < dst")).select(F.col("node").alias("id"), "component")
    roots = written(core.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("root")), "roots")
    numbers = numbered(roots.select("root").distinct(), [F.col("root")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    cores = written(roots.join(numbers, "root").select("id", "cluster"), "cores")
    border = region.join(cores.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("touching"))
    return ids.select("id").join(cores, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "touching", F.lit(0)).alias("cluster"))
