"""Frames that plots are drawn from. Drawing itself is left to plotting libraries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.hdbscan import Hdbscan


def cluster_frame(result: Hdbscan, coords: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, x, y, cluster, glosh, parent, x2, y2, distance): points with their parent in the spanning tree; glosh falls back to lambda."""
    _two(coords)
    xy = coords.select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    up = xy.select(F.col("id").alias("parent"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    points = result.points.select("id", "cluster", F.coalesce("glosh", "lambda").alias("glosh"), F.col("mst_parent").alias("parent"))
    frame = xy.join(points, "id", "left").join(up, "parent", "left")
    if edges is not None:
        known = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"), "dist").groupBy("a", "b").agg(F.min("dist").alias("distance"))
        frame = frame.withColumn("a", F.greatest("id", "parent")).withColumn("b", F.least("id", "parent")).join(known, ["a", "b"], "left")
    else:
        frame = frame.withColumn("distance", F.lit(None).cast("double"))
    return frame.select("id", "x", "y", "cluster", "glosh", "parent", "x2", "y2", "distance")


def _two(coords: DataFrame) -> None:
    row = coords.select(F.size("coords")).first()
    if row is not None and row[0] != 2:
        raise ValueError("only two-dimensional coordinates can be drawn")


def mosaic_frame(coords: DataFrame, images: DataFrame, n: int | None = None, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, xmin, xmax, ymin, ymax, pixels): where images go, of n points taken by hash of (id, seed).

    images is (id, height, width, layers, pixels array<double>); layers 1 is grey, 2 to 4 colours, others are a ValueError, as are
    images that don't belong to points one by one. Pixels become 1 - (v - min) / max over all images.
    """
    _two(coords)
    points, pictures, paired = coords.count(), images.count(), images.join(coords.select("id"), "id").count()
    if points != pictures or paired != points:
        raise ValueError(f"{pictures} images for {points} points")
    low, high, least, most = images.agg(F.min(F.array_min("pixels")), F.max(F.array_max("pixels")), F.min("layers"), F.max("layers")).first()
    if points and (least < 1 or most > 4):
        raise ValueError("images have one to four layers")
    chosen = coords if n is None else coords.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    x, y, w, h = F.col("coords")[0], F.col("coords")[1], F.col("width") * (scale / 2), F.col("height") * (scale / 2)
    grey = F.transform("pixels", lambda v: 1 - F.coalesce(F.try_divide(v - F.lit(low), F.lit(high)), F.lit(0.0)))
    return chosen.join(images, "id").select("id", (x - h).alias("xmin"), (x + h).alias("xmax"), (y - w).alias("ymin"), (y + w).alias("ymax"), grey.alias("pixels"))


def grid_frame(coords: DataFrame, size_x: int = 500, size_y: int = 500, image_size: int = 50, image: Callable[[int], list] | None = None) -> DataFrame:
    """(cell_x, cell_y, id): a mosaic without gaps. Cell by cell, row by row, the nearest point that isn't used yet.

    With image, a function from an id to the numbers of its picture, they come along as pixels, of the chosen points only.
    The choice is sequential: one task holds the points, as two numbers each. ValueError beyond 10 million points.
    """
    _two(coords)
    if coords.count() > 10_000_000:
        raise ValueError("too many points for one picture")
    nx, ny = size_x // image_size, size_y // image_size

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x, y = f.x.to_numpy() - f.x.min(), f.y.to_numpy() - f.y.min()
        x, y = x * (size_x / (x.max() or 1)), y * (size_y / (y.max() or 1))
        rows = []
        for j in range(1, ny + 1):
            for i in range(1, nx + 1):
                if len(rows) == len(f):
                    break
                d = (x - (i - 0.5) * image_size) ** 2 + (y - (j - 0.5) * image_size) ** 2
                k = int(d.argmin())
                x[k] = float("inf")
                rows.append((i, j, int(f.id.iloc[k])))
        made = pd.DataFrame(rows, columns=["cell_x", "cell_y", "id"])
        return made if image is None else made.assign(pixels=[[float(x) for x in image(int(i))] for i in made.id])

    flat = coords.select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    return flat.groupBy(F.lit("all").alias("picture")).applyInPandas(run, "cell_x int, cell_y int, id bigint" + ", pixels array<double>" * (image is not None))


def facet_frame(coords: DataFrame, parameters: DataFrame) -> DataFrame:
    """Coordinates by their standard deviations for every combination of parameters, for facets side by side; ValueError for over 1,000 of them."""
    if parameters.count() > 1000:
        raise ValueError("more than 1,000 facets")
    sx, sy = coords.agg(F.stddev_samp(F.col("coords")[0]), F.stddev_samp(F.col("coords")[1])).first()
    z = lambda k, s: F.try_divide(F.col("coords")[k], F.lit(s))
    return coords.select("id", z(0, sx).alias("x"), z(1, sy).alias("y")).crossJoin(F.broadcast(parameters))
