"""Low-dimensional coordinates of a weight graph by stochastic gradient descent with negative samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.distance import gradient_cap, gradients, negative_gradient, positive_gradient
from nearfold.operators.knn import search
from nearfold.operators.ordering import numbered
from nearfold.operators.weights import edge_weights, negative_weights, rescale_overflow
from nearfold.scratch import written
from nearfold.sources.vectors import random_of

BATCH = 8192
#: Samples whose gradients add up, at most; and ranges of vertices in which the shards' moves are averaged.
AT_ONCE, RANGES = 1 << 15, 16


def sgd_batches(n: Column, edges: Column | None = None) -> Column:
    """How many edge samples a graph of n vertices needs: 2000 a (positive) edge below 10,000 vertices, then by n alone."""
    edges = edges if edges is not None else 150 * n / 2
    middle = 1e6 * (9000 * (n - 1e4) / (1e6 - 1e4) + 1000)
    return F.when(n < 1e4, 2000 * edges).when(n < 1e6, middle).otherwise(1e4 * n)


def resolve_batches(n: int, nnz: int, asked: float | None) -> int:
    """None: the formula; below 1: that fraction of it; else the number asked for. ValueError if negative."""
    if asked is not None and asked < 0:
        raise ValueError("sgd_batches must not be negative")
    if asked is not None and asked >= 1:
        return int(asked)
    full = 2000 * nnz / 2 if n < 1e4 else 1e6 * (9000 * (n - 1e4) / (1e6 - 1e4) + 1000) if n < 1e6 else 1e4 * n
    return int(full * (1 if asked is None else asked))


def starting_coords(ids: DataFrame, dim: int = 2, seed: int = 0) -> DataFrame:
    """(id, coords): uniform in [-0.5, 0.5), by id and seed alone."""
    return ids.select("id", F.array(*(random_of(F.col("id"), seed * 1000 + d) - 0.5 for d in range(dim))).alias("coords"))


class Alias:
    """Weighted sampling in constant time a draw (Walker's method)."""

    def __init__(self, weights: np.ndarray):
        n, scaled = len(weights), np.asarray(weights, float) * len(weights) / np.sum(weights)
        self.prob, self.other = np.ones(n), np.arange(n)
        small, large = list(np.flatnonzero(scaled < 1)), list(np.flatnonzero(scaled >= 1))
        while small and large:
            s, g = small.pop(), large[-1]
            self.prob[s], self.other[s] = scaled[s], g
            scaled[g] -= 1 - scaled[s]
            if scaled[g] < 1:
                small.append(large.pop())

    def draw(self, rng: np.random.Generator, size) -> np.ndarray:
        much = rng.random(size) * len(self.prob)
        at = much.astype(np.int64)
        much -= at
        return np.where(much < self.prob[at], at, self.other[at])


def _descend(coords, velocity, a, b, edges, negative, samples, rng, m, gamma, alpha, rate, momentum):
    """Samples edges and moves coords in place, in batches of up to a quarter of the vertices, whose gradients add up."""
    (n, dim), cap = coords.shape, gradient_cap(alpha, gamma)
    step = max(1, min(AT_ONCE, n // 4))
    x, v = np.ascontiguousarray(coords.T), np.ascontiguousarray(velocity.T)
    for at in range(0, samples, step):
        k = edges.draw(rng, min(step, samples - at))
        i, j, other = a[k], b[k], negative.draw(rng, (m, len(k)))
        own, rho, where = x[:, i], rate(at), np.concatenate([i, j, other.ravel()])
        pull = own - x[:, j]
        pull *= gradients(True, sum(d * d for d in pull), alpha, gamma)
        np.clip(pull, -cap, cap, out=pull)
        push = own[:, None] - x[:, other]
        force = gradients(False, sum(d * d for d in push), alpha, gamma)
        force *= (other != i) & (other != j)
        push *= force
        np.clip(push, -cap, cap, out=push)
        total = np.stack([np.bincount(where, np.concatenate([pull[c] + push[c].sum(0), -pull[c], -push[c].ravel()]), n) for c in range(dim)])
        total *= rho
        if momentum:
            v *= momentum
            v += total
            x += v
        else:
            x += total
    coords[:], velocity[:] = x.T, v.T


def project(
    weights: DataFrame, dim: int = 2, sgd_batches: float | None = None, m: int = 5, gamma: float = 7.0, alpha: float = 1.0, rho: float = 1.0, coords: DataFrame | None = None,
    use_degree: bool = False, momentum: float | None = None, seed: int = 0, edge_sampling: str = "weighted", epochs: int | None = None, shards: int | None = None, most_local: int = 2_000_000,
) -> DataFrame:
    """(id, coords) of a symmetric weight graph (src, dst, weight). Fewer than 8,192 samples leave the coordinates as they are.

    Up to most_local vertices (checked) every epoch sends the coordinates to `shards` partitions of edges, each of which
    descends by itself; their moves are averaged over the shards that touched a vertex, by ranges of vertices in tasks, so what
    reaches the driver in an epoch is one move and one speed a vertex. Beyond that nothing is sent: an epoch
    thins the edges by weight, joins both ends' and the negative samples' coordinates, and adds up gradients per vertex. There an
    epoch's moves of a vertex are one step, clipped as a whole, so `epochs`, 40 where it is None, are then as many as leave a vertex
    about four edge samples an epoch, 40 at least and 400 at most. momentum lies between 0 and 0.95.
    Both depend on seed, not on the cluster's size.
    """
    if momentum is not None and not 0 <= momentum <= 0.95:
        raise ValueError("momentum must lie between 0 and 0.95")
    if alpha < 0 or gamma < 0 or rho < 0 or m < 0 or edge_sampling not in ("weighted", "uniform"):
        raise ValueError("alpha, gamma, rho and m must not be negative; edge_sampling is weighted or uniform")
    weights = written(weights.select("src", "dst", "weight"), "weights")
    ids = weights.select(F.col("src").alias("id")).unionByName(weights.select(F.col("dst").alias("id"))).distinct()
    ids = written(ids if coords is None else ids.unionByName(coords.select("id")).distinct(), "ids")
    now = written(starting_coords(ids, dim, seed) if coords is None else coords.select("id", F.col("coords").cast("array<double>")), "coords")
    n, nnz = ids.count(), weights.count()
    samples = resolve_batches(n, nnz, sgd_batches) // BATCH * BATCH
    if not samples or not nnz:
        return now
    neg = negative_weights(weights, use_degree)
    if epochs is None:
        epochs = 40 if n <= most_local else max(40, min(400, samples // (2 * n)))
    epochs = max(1, min(epochs, samples // BATCH))
    if n > most_local:
        return _project_joined(weights, now, neg, n, nnz, samples, epochs, m, gamma, alpha, rho, seed, edge_sampling, momentum or 0.0)
    placed = numbered(now, [F.col("id")], "at").select("id", "coords", (F.col("at") - 1).alias("at")).join(neg, "id", "left").toArrow().sort_by("at")
    order = placed.column("id").to_numpy()
    x = placed.column("coords").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
    prob = np.nan_to_num(placed.column("weight").to_numpy())
    shards = shards or max(1, min(8, nnz // 20_000))
    edges = weights.withColumn("shard", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(shards)).cast("int"))
    edges = written(edges.repartitionById(shards, F.col("shard")), "edges")
    velocity, each = np.zeros_like(x), samples // epochs // shards
    context, bounds = now.sparkSession.sparkContext, np.linspace(0, len(x), RANGES + 1).astype(np.int64)
    fixed = context.broadcast((order, Alias(prob)))

    def shard_of(table: pa.Table):
        """Of a shard's edges, in their order: both ends' places, a sampler, and the shard's number."""
        table = table.sort_by([("src", "ascending"), ("dst", "ascending")])
        a, b = (np.searchsorted(fixed.value[0], table.column(c).to_numpy()) for c in ("src", "dst"))
        w = table.column("weight").to_numpy()
        return a, b, Alias(np.ones(len(w)) if edge_sampling == "uniform" else w), int(table.column("shard")[0].as_py())

    def descend(shard, held: np.ndarray, speed: np.ndarray, epoch: int):
        a, b, sampler, number = shard
        mine, v = held.copy(), speed.copy()
        rate = lambda k: max(1e-4, rho * (1 - (epoch + k / max(1, each)) / epochs))
        _descend(mine, v, a, b, sampler, fixed.value[1], each, np.random.default_rng([seed, number, epoch]), m, gamma, alpha, rate, momentum)
        moved = (mine != held).any(1)
        return moved, np.where(moved[:, None], mine - held, 0), np.where(moved[:, None], v, 0)

    columns = ["range", "shard", "moved", "d", "v"]
    whole = shard_of(edges.toArrow()) if shards == 1 else None
    for epoch in range(epochs):
        if whole is not None:
            _, d, velocity = descend(whole, x, velocity, epoch)
            x = x + d
            continue
        sent = context.broadcast((x, velocity, epoch))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if batches:
                shard = shard_of(pa.Table.from_batches(batches))
                made = descend(shard, *sent.value)  # noqa: B023
                for r, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([shard[3]], pa.int32()), *(pa.array([y[low:high].tobytes()], pa.binary()) for y in made)], columns)

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((tuple(row.values()) for b in batches for row in b.to_pylist()), key=lambda row: row[:2])
            for r in sorted({row[0] for row in rows}):
                parts = [row for row in rows if row[0] == r]
                seen = np.maximum(1, sum(np.frombuffer(row[2], bool).astype(int) for row in parts))[:, None]
                mean = [sum(np.frombuffer(row[c], float).reshape(len(seen), -1) for row in parts) / seen for c in (3, 4)]
                yield pa.record_batch([pa.array([r], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in mean)], ["range", "d", "v"])

        made = edges.repartitionById(shards, F.col("shard")).mapInArrow(run, "range int, shard int, moved binary, d binary, v binary")
        got = made.repartitionById(RANGES, F.col("range")).mapInArrow(average, "range int, d binary, v binary").toArrow().sort_by("range")
        d, velocity = (np.frombuffer(b"".join(got.column(c).to_pylist()), float).reshape(x.shape) for c in ("d", "v"))
        x = x + d
        sent.destroy()
    fixed.destroy()
    at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    return now.sparkSession.createDataFrame(pa.table({"id": pa.array(order), "coords": pa.ListArray.from_arrays(at, pa.array(x.ravel()))}))


def _project_joined(weights, now, neg, n, nnz, samples, epochs, m, gamma, alpha, rho, seed, edge_sampling, momentum) -> DataFrame:
    """Synchronous descent by joins alone, for graphs whose coordinates aren't sent anywhere."""
    dim = len(now.first().coords)
    total = weights.agg(F.sum("weight")).first()[0]
    share = samples / epochs / nnz
    chance = F.lit(share) if edge_sampling == "uniform" else F.col("weight") * F.lit(share * nnz / total)
    mean = neg.agg(F.avg("weight")).first()[0]
    index = written(numbered(now.select("id").join(neg, "id", "left"), [F.col("id")], "at").select("id", (F.col("at") - 1).alias("at"), (F.coalesce("weight", F.lit(0.0)) / mean).alias("neg")), "index")
    cap = gradient_cap(alpha, gamma)
    diff = lambda: F.zip_with("ca", "cb", lambda p, q: p - q)
    clip = lambda f: F.transform("d", lambda x: F.greatest(F.lit(-cap), F.least(F.lit(cap), f * x)))
    d2 = F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x)
    now = now.withColumn("speed", F.transform("coords", lambda x: x * 0.0))
    for epoch in range(epochs):
        rate = max(1e-4, rho * (1 - epoch / epochs))
        drawn = F.floor(chance + random_of(F.concat_ws(",", "src", "dst"), seed + 7 * epoch)).cast("int")
        pos = weights.select("src", "dst", drawn.alias("times")).filter("times > 0")
        other = lambda j: F.floor(random_of(F.concat_ws(",", "src", "dst", F.lit(j)), seed + 7 * epoch + 1) * n)  # noqa: B023, E731
        negs = pos.select("src", F.col("dst").alias("not"), "times", F.explode(F.array(*(other(j) for j in range(m)))).alias("at")).join(index, "at").filter("id <> src and id <> not")
        pairs = pos.select("src", "dst", F.col("times").cast("double").alias("times"), F.lit(True).alias("attract"))
        pairs = pairs.unionByName(negs.select("src", F.col("id").alias("dst"), (F.col("times") * F.col("neg")).alias("times"), F.lit(False).alias("attract")))
        at = pairs.join(now.select(F.col("id").alias("src"), F.col("coords").alias("ca")), "src").join(now.select(F.col("id").alias("dst"), F.col("coords").alias("cb")), "dst")
        force = F.when(F.col("attract"), positive_gradient(d2, alpha)).otherwise(negative_gradient(d2, alpha, gamma))
        g = at.withColumn("d", diff()).withColumn("g", clip(force)).withColumn("g", F.transform("g", lambda x: x * F.col("times")))
        ends = g.select(F.col("src").alias("id"), "g").unionByName(g.select(F.col("dst").alias("id"), F.transform("g", lambda x: -x).alias("g")))
        moves = ends.groupBy("id").agg(F.array(*(F.sum(F.col("g")[k]) for k in range(dim))).alias("move"))
        step = F.transform("move", lambda x: F.greatest(F.lit(-cap), F.least(F.lit(cap), x * rate)))
        speed = F.when(F.col("move").isNull(), F.transform("speed", lambda x: x * momentum)).otherwise(F.zip_with("speed", step, lambda p, q: p * momentum + q))
        moved = now.join(moves, "id", "left").select("id", "coords", speed.alias("speed"))
        now = written(moved.select("id", F.zip_with("coords", "speed", lambda p, q: p + q).alias("coords"), "speed"), "coords")
    return now.select("id", "coords")


@dataclass
class Layout:
    """What the whole pipeline gives: coordinates, weights, and the neighbour edges if kept."""

    coords: DataFrame
    weights: DataFrame
    edges: DataFrame | None


def layout(
    vectors: DataFrame, dim: int = 2, k: int = 50, n_trees: int = 50, max_iter: int = 1, metric: str = "euclidean", perplexity: float | None = None, keep_edges: bool = True, **options
) -> Layout:
    """Vectors to coordinates: search, overflow guard, weights, descent."""
    edges = written(rescale_overflow(search(vectors, k, n_trees, max_iter, metric)), "edges")
    weights = written(edge_weights(edges, perplexity or max(50.0, k / 3)), "weights")
    return Layout(project(weights, dim, **options), weights, edges if keep_edges else None)


def layout_of_graph(edges: DataFrame, dim: int = 2, **options) -> DataFrame:
    """Coordinates of a symmetric weighted graph as it is, without any search."""
    return project(edges, dim, **options)

