"""Edge weights calibrated to a perplexity."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rescale_overflow(edges: DataFrame, limit: float = 27.0) -> DataFrame:
    """All distances by the largest one, if that exceeds limit; else as they are."""
    top = edges.agg(F.max("dist")).first()[0]
    if top is None or top <= limit:
        return edges
    warnings.warn(f"distances above {limit:g} are scaled down", stacklevel=2)
    return edges.withColumn("dist", F.col("dist") / F.lit(top))


def calibrate(w: np.ndarray, valid: np.ndarray, perplexity: float, rounds: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Row-wise p proportional to exp(-beta w), beta found by bisection so that the entropy is log(perplexity)."""
    n = len(w)
    beta, low, high = np.ones(n), np.full(n, -np.inf), np.full(n, np.inf)
    p, live, goal = np.zeros_like(w), np.arange(n), np.log(perplexity)
    for _ in range(rounds):
        x, ok = w[live], valid[live]
        e = np.where(ok, np.exp(-beta[live][:, None] * x), 0.0)
        total = e.sum(1)
        total = np.where(total == 0, np.finfo(float).tiny, total)
        h = beta[live] * (np.where(ok, x, 0) * e).sum(1) / total + np.log(total)
        p[live] = e / total[:, None]
        off = h - goal
        open_ = np.abs(off) >= tolerance
        up = off > 0
        b, lo, hi = beta[live], low[live], high[live]
        lo, hi = np.where(up, b, lo), np.where(up, hi, b)
        b = np.where(up, np.where(np.isinf(hi), b * 2, (b + hi) / 2), np.where(np.isinf(lo), b / 2, (b + lo) / 2))
        beta[live], low[live], high[live] = b, lo, hi
        live = live[open_]
        if not live.size:
            break
    return p


def conditional(edges: DataFrame, perplexity: float = 50.0, distance_power: int = 4) -> DataFrame:
    """(src, dst, p): p of dst given src, over src's neighbours. distance_power 2 is the published method, 4 the default here."""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "dist"))).alias("x")).select("src", "x.dst", "x.dist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x) for x in batch.column("dst").to_pylist()])
            valid = np.arange(sizes.max())[None, :] < sizes[:, None]
            w = np.zeros(valid.shape)
            w[valid] = batch.column("dist").flatten().to_numpy(zero_copy_only=False) ** distance_power
            p = calibrate(w, valid, perplexity)
            yield pa.record_batch([pa.array(np.repeat(batch.column("src").to_numpy(), sizes)), batch.column("dst").flatten(), pa.array(p[valid])], ["src", "dst", "p"])

    return rows.mapInArrow(run, "src bigint, dst bigint, p double")


def uniform(edges: DataFrame) -> DataFrame:
    """The closed form where the perplexity exceeds the number of neighbours: every p is one by that number."""
    n = edges.groupBy("src").agg(F.count("*").alias("n"))
    return edges.join(n, "src").select("src", "dst", (F.lit(1.0) / F.col("n")).alias("p"))


def symmetrize(p: DataFrame) -> DataFrame:
    """(src, dst, weight): half the sum of both directions, an absent one being 0; both directions are given."""
    flipped = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")
    return p.select("src", "dst", "p").unionByName(flipped).groupBy("src", "dst").agg((F.sum("p") / 2).alias("weight"))


def edge_weights(edges: DataFrame, perplexity: float = 50.0, distance_power: int = 4) -> DataFrame:
    """The weight graph of a neighbour graph."""
    return symmetrize(conditional(edges, perplexity, distance_power))


def negative_weights(weights: DataFrame, use_degree: bool = False) -> DataFrame:
    """(id, weight): how often a vertex is drawn as a negative sample, its summed weight or in-degree to the power 0.75."""
    if use_degree:
        return weights.groupBy(F.col("dst").alias("id")).agg(F.pow(F.count("*").cast("double"), 0.75).alias("weight"))
    return weights.groupBy(F.col("src").alias("id")).agg(F.pow(F.sum("weight"), 0.75).alias("weight"))
