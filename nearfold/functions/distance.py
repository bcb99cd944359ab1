"""Distances between two array columns, and the same over numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan", "hamming")


def check_metric(name: str) -> str:
    """The metric in lower case; ValueError for one that isn't known."""
    if str(name).lower() not in METRICS:
        raise ValueError(f"metric {name!r} is none of {', '.join(METRICS)}")
    return str(name).lower()


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Euclidean: root of summed squares. Cosine: sqrt(2 - 2 cos), 2 cos being 0 for a zero vector. Manhattan: summed
    differences. Hamming: differing bits of the elements as 64-bit integers, which counts mismatches of 0/1 data.
    """
    metric = check_metric(metric)
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    if metric == "hamming":
        return _sum(a, b, lambda x, y: F.bit_count(x.cast("bigint").bitwiseXOR(y.cast("bigint"))).cast("double"))
    dot = _sum(a, b, lambda x, y: x * y)
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y) * _sum(b, b, lambda x, y: x * y))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - F.coalesce(F.try_divide(2 * dot, norms), F.lit(0.0))))


def block_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """[len(q), len(x)] distances by direct differences: no cancellation near zero."""
    if metric == "cosine":
        norms = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None, :])
        cos = np.divide(q @ x.T, norms, out=np.zeros((len(q), len(x))), where=norms > 0)
        return np.sqrt(np.maximum(0, 2 - 2 * cos))
    out = np.empty((len(q), len(x)))
    step = max(1, 4_000_000 // max(1, x.size))
    for at in range(0, len(q), step):
        part = q[at : at + step, None, :]
        if metric == "euclidean":
            d = part - x
            out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        elif metric == "manhattan":
            out[at : at + step] = np.abs(part - x).sum(-1)
        else:
            out[at : at + step] = np.bitwise_count((part.astype(np.int64) ^ x.astype(np.int64)).view(np.uint64)).sum(-1)  # of signed ones it would count the absolute value's
    return out


def positive_gradient(d2: Column, alpha: float) -> Column:
    """What the difference of two joined points is multiplied by, d2 being their squared distance."""
    if alpha == 0:
        return F.when(d2 > 4, -1.0).otherwise(-1 / (1 + F.exp(-F.least(d2, F.lit(4.0)))))
    return -2.0 * alpha / (1 + alpha * d2)


def negative_gradient(d2: Column, alpha: float, gamma: float) -> Column:
    """The same for a pair of a negative sample; at distance zero it is bounded, not undefined."""
    if alpha == 0:
        return F.when(d2 > gamma * gamma, 0.0).otherwise(gamma / (1 + F.exp(F.least(d2, F.lit(gamma * gamma)))))
    if alpha == 1:
        return 2.0 * gamma / (1 + d2) / (0.1 + d2)
    return F.coalesce(F.try_divide(F.lit(2.0 * alpha * gamma), d2 * (alpha * d2 + 1)), F.lit(0.0))


def gradient_cap(alpha: float, gamma: float) -> float:
    return gamma if alpha == 0 else 5.0


def gradients(positive: bool, d2: np.ndarray, alpha: float, gamma: float) -> np.ndarray:
    """The numpy twin of both."""
    if positive:
        return np.where(d2 > 4, -1.0, -1 / (1 + np.exp(-np.minimum(d2, 4)))) if alpha == 0 else -2.0 * alpha / (1 + alpha * d2)
    if alpha == 0:
        return np.where(d2 > gamma**2, 0.0, gamma / (1 + np.exp(np.minimum(d2, gamma**2))))
    if alpha == 1:
        return 2.0 * gamma / (1 + d2) / (0.1 + d2)
    return np.divide(2.0 * alpha * gamma, d2 * (alpha * d2 + 1), out=np.zeros_like(d2), where=d2 > 0)
