"""Nearest neighbours: exact in blocks, by a forest of random hyperplanes, and by exploring neighbours of neighbours."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions.distance import check_metric, distance
from nearfold.functions.nearest import Nearest
from nearfold.scratch import written

EDGES = "src bigint, dst bigint, rank int, dist double"


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, dist): the k nearest of each src by (dist, dst). The rank is cut before the shuffle too."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", "rank", "dist")


def tagged(edges: DataFrame, metric: str) -> DataFrame:
    """edges with the metric in the metadata of their distances."""
    return edges.withMetadata("dist", {"metric": metric})


def metric_of(edges: DataFrame) -> str | None:
    """The metric that a neighbour graph was made with, if it tells."""
    return edges.schema["dist"].metadata.get("metric")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _batches(found: Nearest) -> Iterator[pa.RecordBatch]:
    for src, dst, rank, dist in found.found():
        yield pa.record_batch([pa.array(src), pa.array(dst), pa.array(rank), pa.array(dist)], ["src", "dst", "rank", "dist"])


def checked(vectors: DataFrame) -> tuple[int, int]:
    """(number of vectors, their size). ValueError for null or repeated ids, null vectors, vectors of several sizes, and elements that are null or not finite."""
    odd = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = vectors.agg(
        F.count("*").alias("n"), F.count("id").alias("with_id"), F.count_distinct("id").alias("ids"), F.count("features").alias("with_vector"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"),
        F.count_if(odd).alias("odd"),
    ).first()
    wrong = {"without an id": seen.n - seen.with_id, "with an id that another has": seen.with_id - seen.ids, "without a vector": seen.n - seen.with_vector, "with elements that are null or not finite": seen.odd}
    for what, n in wrong.items():
        if n:
            raise ValueError(f"{n} rows {what}")
    if seen.n and seen.low != seen.high:
        raise ValueError(f"vectors of {seen.low} to {seen.high} elements")
    return seen.n, seen.high or 0


def _cells(vectors: DataFrame, n: int, most: int, sample: int = 50_000) -> DataFrame:
    """(id, features, leaf): cells of space of about `most` vectors each, cut at medians along the widest side of a sample."""
    chosen = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1)
    rows = sorted((r.id, r.features) for r in chosen.select("id", "features").limit(2 * sample).collect())
    x = np.array([f for _, f in rows], float).reshape(len(rows), -1)
    least, normals, offsets, children = max(2, int(most * len(x) / max(1, n))), [], [], []

    def split(at: np.ndarray) -> int:
        if len(at) <= least:
            return -1
        widest = int(np.argmax(np.ptp(x[at], axis=0)))
        values = x[at, widest]
        cut = np.median(values)
        below = values[values < values.max()]
        if not len(below):
            return -1  # copies of one point
        cut = min(cut, below.max())
        node = len(normals)
        normals.append(np.eye(x.shape[1])[widest])
        offsets.append(cut)
        children.append([-1, -1])
        children[node] = [split(at[values <= cut]), split(at[values > cut])]
        return node

    root = split(np.arange(len(x)))
    tree = {"root": root, "normals": np.array(normals).reshape(len(normals), x.shape[1]), "offsets": np.array(offsets), "children": np.array(children, np.int64).reshape(-1, 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("id"), batch.column("features"), pa.array(Forest([tree]).leaves(_matrix(batch.column("features")), tree))], ["id", "features", "leaf"])

    return vectors.select("id", "features").mapInArrow(run, "id bigint, features array<double>, leaf bigint")


def _packed(cells: DataFrame, k: int, metric: str, bounded: bool) -> DataFrame:
    """(block, low, high, far, id, x) of (id, features, block): ids and elements of a block as bytes. bounded: with its box and the largest distance of any row to its k-th nearest in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x = batch.column("id")[r].values.to_numpy(), _matrix(batch.column("features")[r].values)
                far = np.inf
                if bounded:
                    own = Nearest(ids, x, k, metric)
                    own.add(ids, x)
                    far = float(own.dist[:, -1].max())
                box = [pa.array([x.min(0).tolist()], pa.list_(pa.float64())), pa.array([x.max(0).tolist()], pa.list_(pa.float64()))]
                yield pa.record_batch([batch.column("block").slice(r, 1), *box, pa.array([far]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "low", "high", "far", "id", "x"])

    rows = cells.groupBy("block").agg(F.collect_list(F.struct("id", "features")).alias("v")).select("block", "v.id", "v.features")
    return rows.mapInArrow(run, "block bigint, low array<double>, high array<double>, far double, id binary, x binary")


def _partners(packed: DataFrame, metric: str) -> DataFrame:
    """(a, block, pos): the blocks that may hold one of the k nearest of a row of block a, itself first and then by the distance of their boxes."""
    a = packed.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), "far")
    gap = F.zip_with(F.zip_with("low", "ha", lambda x, y: x - y), F.zip_with("la", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    gap = F.aggregate(gap, F.lit(0.0), lambda s, x: s + (x * x if metric == "euclidean" else x))
    gap = (F.sqrt(gap) if metric == "euclidean" else gap) * (1 - 1e-9)
    pairs = a.join(F.broadcast(packed.select("block", "low", "high"))).select("a", "block", "far", gap.alias("pos")).filter("pos <= far")
    return pairs.select("a", "block", F.when(F.col("a") == F.col("block"), -0.5).otherwise(F.col("pos")).alias("pos"))


def exact_knn(vectors: DataFrame, k: int, metric: str = "euclidean", block: int | None = None) -> DataFrame:
    """The k nearest of every vector by (distance, id), itself excluded, as (src, dst, rank, dist).

    Vectors are packed into blocks; a task holds one block, to which the others come one by one, and keeps its rows' k best so far: no side
    is broadcast and no task holds more than two blocks (`block` vectors each, by default as many as have two million elements).
    Up to eight elements of a metric that boxes bound, blocks are cells of space, and those that are farther than a block's worst k-th neighbour in
    itself don't come: the work is in proportion to the vectors. Else every pair of blocks meets, n squared, and a block's partners are
    divided among as many tasks as keep the cluster busy. ValueError for what `checked` names; an empty table gives an empty one.
    """
    metric = check_metric(metric)
    n, size = checked(vectors)
    at_once = vectors.sparkSession.sparkContext.defaultParallelism
    near_only = 0 < size <= 8 and metric in ("euclidean", "manhattan")
    most = block or (2048 if near_only else min(65_536, max(1024, (1 << 21) // max(1, size))))
    blocks = max(1, math.ceil(n / most), min(math.ceil((2 * at_once) ** 0.5), n // 256))
    if near_only and blocks > 1:
        cells = written(_cells(vectors, n, math.ceil(n / blocks)), "cells")
        parts = F.broadcast(cells.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * most)).alias("parts")))
        cells = cells.join(parts, "leaf").select("id", "features", (F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    else:
        near_only, cells = False, vectors.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    packed = written(_packed(cells, k, metric, near_only), "blocks")
    if near_only:
        groups = 1
        pairs = _partners(packed, metric).withColumn("g", F.lit(0))
        right = packed.select("block", "id", "x").join(pairs, "block").select("a", "g", "pos", "id", "x")
        tasks, at = min(max(4 * at_once, 64), blocks), F.pmod(F.xxhash64("a"), F.lit(1 << 20))
    else:
        groups = min(blocks, max(1, math.ceil(8 * at_once / blocks)))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        right = packed.select(every(blocks).alias("a"), F.pmod("block", F.lit(groups)).cast("int").alias("g"), F.lit(0.0).alias("pos"), "id", "x")
        tasks, at = blocks * groups, F.col("a") * groups + F.col("g")
    left = packed.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(-1.0).alias("pos"), "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                now = batch.column("a")[r].as_py(), batch.column("g")[r].as_py()
                ids = np.frombuffer(batch.column("id")[r].as_buffer(), np.int64)
                x = np.frombuffer(batch.column("x")[r].as_buffer(), float).reshape(len(ids), -1)
                if now != key:  # the block itself comes first
                    if mine is not None:
                        yield from _batches(mine)
                    key, mine = now, Nearest(ids.copy(), x.copy(), k, metric)
                else:
                    mine.add(ids, x)
        if mine is not None:
            yield from _batches(mine)

    met = left.unionByName(right).repartitionById(max(1, tasks), F.pmod(at, F.lit(max(1, tasks))).cast("int")).sortWithinPartitions("a", "g", "pos")
    found = met.mapInArrow(run, EDGES)
    return tagged(found if groups == 1 else top_k(found, k), metric)


class Forest:
    """Random hyperplane trees, learned on a bounded sample: each split lies midway between two random points of its node.

    Trees are small (their size depends on the sample, not the table) and go to the tasks with the closure.
    """

    def __init__(self, trees: list[dict]):
        self.trees = trees

    @staticmethod
    def grow(vectors: DataFrame, n_trees: int, leaf: int, sample: int = 20_000, seed: int = 1, metric: str = "euclidean") -> Forest:
        n = vectors.count()
        chosen = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1)
        rows = sorted((r.id, r.features) for r in chosen.select("id", "features").limit(2 * sample).collect())
        x = np.array([f for _, f in rows], float).reshape(len(rows), -1)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        least = max(2, int(leaf * min(1, len(x) / max(1, n))))
        trees = []
        for t in range(n_trees):
            rng = np.random.default_rng([seed, t])
            normals, offsets, children = [], [], []

            def split(at: np.ndarray, depth: int) -> int:
                if len(at) <= least or depth > 40:
                    return -1
                for _ in range(5):
                    a, b = x[rng.choice(at, 2, replace=False)]
                    normal = a - b
                    if normal.any():
                        break
                else:
                    return -1
                offset = float(normal @ (a + b) / 2)
                side = x[at] @ normal > offset
                if side.all() or not side.any():
                    return -1
                node = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([-1, -1])
                children[node] = [split(at[~side], depth + 1), split(at[side], depth + 1)]
                return node

            root = split(np.arange(len(x)), 0)
            trees.append({"root": root, "normals": np.array(normals).reshape(len(normals), x.shape[1]), "offsets": np.array(offsets), "children": np.array(children, np.int64).reshape(-1, 2)})
        return Forest(trees)

    def leaves(self, x: np.ndarray, tree: dict) -> np.ndarray:
        """A number for the leaf of each row: its last node and side."""
        node = np.full(len(x), tree["root"])
        leaf = np.full(len(x), -1)
        live = np.flatnonzero(node >= 0)
        while live.size:
            side = (np.einsum("ij,ij->i", x[live], tree["normals"][node[live]]) > tree["offsets"][node[live]]).astype(np.int64)
            leaf[live] = 2 * node[live] + side
            node[live] = tree["children"][node[live], side]
            live = live[node[live] >= 0]
        return leaf


def assign_leaves(vectors: DataFrame, forest: Forest, metric: str = "euclidean") -> DataFrame:
    """(id, tree, leaf) for every vector and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("features"))
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            for t, tree in enumerate(forest.trees):
                yield pa.record_batch([batch.column("id"), pa.array(np.full(len(x), t, np.int32)), pa.array(forest.leaves(x, tree))], ["id", "tree", "leaf"])

    return vectors.select("id", "features").mapInArrow(run, "id bigint, tree int, leaf bigint")


def forest_knn(leaves: DataFrame, vectors: DataFrame, k: int, metric: str = "euclidean", most: int = 4096, trees_at_once: int = 8) -> DataFrame:
    """The k nearest among those that share a leaf of some tree. leaves is (id, tree, leaf), a written table.

    Vectors are joined to the leaves of trees_at_once trees at a time, whose neighbours are then reduced to each vector's k best: what
    is shuffled at once is as many copies of the vectors, and nothing but edges is kept. A leaf of more than `most` vectors is cut by
    hash, and every two parts of it meet in a task of their own: no task holds more than two parts, and no pair is lost.
    """
    metric = check_metric(metric)
    large = written(leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1"), "large_leaves")
    large = F.broadcast(large) if large.count() <= 100_000 else large.hint("merge")
    own = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int")
    spread = (
        leaves.join(large, ["tree", "leaf"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "tree", "leaf", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x = batch.column("id")[r].values.to_numpy(), _matrix(batch.column("features")[r].values)
                found = Nearest(ids, x, k, metric)
                found.add(ids, x)
                yield from _batches(found)

    trees, found = leaves.agg(F.max("tree")).first()[0], None
    for first in range(0, (0 if trees is None else trees) + 1, trees_at_once):
        mine = spread.filter(F.col("tree").between(first, first + trees_at_once - 1)).join(vectors.select("id", "features"), "id")
        packed = mine.groupBy("tree", "leaf", "low", "high").agg(F.collect_list(F.struct("id", "features")).alias("v")).select("v.id", "v.features")
        near = packed.mapInArrow(run, EDGES).drop("rank")
        if found is not None:
            near = near.unionByName(found.select("src", "dst", "dist"))
        found = written(top_k(near.groupBy("src", "dst").agg(F.min("dist").alias("dist")), k), "forest_edges")
    return found


def explore(edges: DataFrame, vectors: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """One round of exploration: of each vertex's neighbours and theirs, without itself, the k nearest.

    Candidates are made distinct before any distance is computed; known distances are kept.
    """
    hop = edges.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").filter("src <> dst")
    new = hop.distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    a = vectors.select(F.col("id").alias("src"), F.col("features").alias("fa"))
    b = vectors.select(F.col("id").alias("dst"), F.col("features").alias("fb"))
    far = new.join(a, "src").join(b, "dst").select("src", "dst", distance(F.col("fa"), F.col("fb"), metric).alias("dist"))
    return top_k(edges.select("src", "dst", "dist").unionByName(far), k)


def search(
    vectors: DataFrame, k: int = 150, n_trees: int = 50, max_iter: int = 1, metric: str = "euclidean", leaf: int | None = None, seed: int = 1, save: str | None = None, goal: float | None = None
) -> DataFrame:
    """Approximate nearest neighbours: forest, its candidates, max_iter rounds of exploration. save: a folder for the index.

    goal: a recall to be reached. Leaves then grow fourfold until the trees alone reach it by two hundredths more, as measured on some 500 vectors
    against brute force over all; where the leaves would cost as many distances as all pairs, all pairs are compared. It can't be had with save.
    ValueError for what `checked` names, and for vectors that share no leaf with any other.
    """
    from nearfold.sources.index_store import save_index

    metric = check_metric(metric)
    if goal is not None and save:
        raise ValueError("a goal can't be had with a stored index")
    n, size = checked(vectors)
    leaf = leaf or max(k, size, 1)
    forest = Forest.grow(vectors, n_trees, leaf, seed=seed, metric=metric)
    if goal is not None:
        queries = sampled_truth(vectors, k, metric, n, seed=seed)
        while shared(forest, *queries, metric) < min(1.0, goal + 0.02):
            leaf *= 4
            if n_trees * leaf >= n:
                return exact_knn(vectors, k, metric)
            forest = Forest.grow(vectors, n_trees, leaf, seed=seed, metric=metric)
    leaves = written(assign_leaves(vectors, forest, metric), "leaves")
    if save:
        save_index(vectors, leaves, metric, save)
    return refine(leaves, vectors, k, max_iter, metric)


def sampled_truth(vectors: DataFrame, k: int, metric: str, n: int, sample: int = 500, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(x, near): vectors of some 500 queries taken by hash and all of their k nearest, and pairs of places in x, query and neighbour. Exact, over all rows."""
    chosen = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 40)) < int((1 << 40) * sample / n) + 1)
    asked = chosen.select("id", "features").toArrow().sort_by("id")
    ids, x = asked.column("id").to_numpy(), _matrix(asked.column("features").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Nearest(ids, x, k, metric)
        for batch in batches:
            if batch.num_rows:
                found.add(batch.column("id").to_numpy(), _matrix(batch.column("features")))
        yield from _batches(found)

    near = written(top_k(vectors.select("id", "features").mapInArrow(run, EDGES), k), "truth")
    wanted = near.select(F.col("src").alias("id")).unionByName(near.select(F.col("dst").alias("id"))).distinct()
    rows = vectors.select("id", "features").join(F.broadcast(wanted), "id").toArrow().sort_by("id")
    place, pairs = rows.column("id").to_numpy(), near.select("src", "dst").toArrow()
    at = np.stack([np.searchsorted(place, pairs.column(c).to_numpy()) for c in ("src", "dst")], 1)
    return _matrix(rows.column("features").combine_chunks()), at


def shared(forest: Forest, x: np.ndarray, near: np.ndarray, metric: str) -> float:
    """The share of neighbours that are in a leaf with their query in some tree: the least recall of a search in these leaves."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    met = np.zeros(len(near), bool)
    for tree in forest.trees:
        leaf = forest.leaves(x, tree)
        met |= leaf[near[:, 0]] == leaf[near[:, 1]]
    return float(met.mean()) if len(met) else 1.0


def refine(leaves: DataFrame, vectors: DataFrame, k: int, max_iter: int, metric: str) -> DataFrame:
    edges = forest_knn(leaves, vectors, k, metric)
    for _ in range(max_iter):
        edges = written(explore(edges, vectors, k, metric), "edges")
    check_complete(edges, vectors, k)
    return tagged(edges, metric)


def check_complete(edges: DataFrame, vectors: DataFrame, k: int) -> None:
    """ValueError if a vector has no neighbours, a warning if some have fewer than k."""
    none, few = completeness(edges, vectors, k).first()
    if none:
        raise ValueError(f"{none} vectors have no neighbours")
    if few:
        warnings.warn(f"{few} vectors have fewer than {k} neighbours", stacklevel=2)


def completeness(edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(without, fewer): how many vectors have no neighbours, and how many have some but fewer than k."""
    counts = vectors.select(F.col("id").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("n")), "src", "left")
    return counts.agg(F.count_if(F.col("n").isNull()).alias("without"), F.count_if(F.col("n") < k).alias("fewer"))


def search_grid(vectors: DataFrame, k: int, trees: list[int], rounds: list[int], metric: str = "euclidean", leaf: int | None = None) -> list[tuple[int, int, float, float]]:
    """(n_trees, max_iter, seconds, recall) of every combination, against exact neighbours."""
    exact = written(exact_knn(vectors, k, metric), "exact")
    out = []
    for t in trees:
        for r in rounds:
            began = time.time()
            found = written(search(vectors, k, t, r, metric, leaf), "found")
            out.append((t, r, time.time() - began, recall(exact, found).first().recall))
    return out


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(hits, total, recall) of found edges against exact ones."""
    hits = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("hits"), F.count("*").alias("total")).withColumn("recall", F.try_divide(F.col("hits"), F.col("total")))
