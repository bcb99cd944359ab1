"""Neighbour lists, edge lists and distance tables into one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.distance import distance


def to_neighbors(edges: DataFrame) -> DataFrame:
    """(src, neighbors array<struct<dst, dist>>), nearest first; lists are as long as they are, without padding."""
    near = F.array_sort(F.collect_list(F.struct("dist", "dst")))
    return edges.groupBy("src").agg(F.transform(near, lambda x: F.struct(x["dst"].alias("dst"), x["dist"].alias("dist"))).alias("neighbors"))


def from_neighbors(neighbors: DataFrame) -> DataFrame:
    """(src, dst, rank, dist). A list ends at its first null, and what follows is no neighbour."""
    rows = neighbors.select("src", F.posexplode("neighbors").alias("at", "x"), F.array_position(F.transform("neighbors", lambda x: x["dst"].isNull()), True).alias("end"))
    return rows.filter((F.col("end") == 0) | (F.col("at") + 1 < F.col("end"))).select("src", "x.dst", (F.col("at") + 1).cast("int").alias("rank"), "x.dist")


def count_valid(neighbors: DataFrame) -> DataFrame:
    """(n_edges): how many neighbours there are, nulls not counted."""
    return neighbors.agg(F.coalesce(F.sum(F.size(F.filter("neighbors", lambda x: x["dst"].isNotNull()))), F.lit(0)).cast("bigint").alias("n_edges"))


def measure(pairs: DataFrame, vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(src, dst, dist) with distances computed anew from the vectors."""
    a = vectors.select(F.col("id").alias("src"), F.col("features").alias("fa"))
    b = vectors.select(F.col("id").alias("dst"), F.col("features").alias("fb"))
    return pairs.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", distance(F.col("fa"), F.col("fb"), metric).alias("dist"))


def reverse(edges: DataFrame) -> DataFrame:
    """Edges from each vertex to those that have it as a neighbour."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return edges.select("src", "dst", "dist").unionByName(reverse(edges)).groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def distance_table(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(i, j, dist) of all i > j, null where neither has the other as a neighbour. Its result has n (n - 1) / 2 rows by definition.

    None of these rows is shuffled or sorted: what is known of an i comes as one row, and a task writes out its i against all ids, which are sent
    to every task (8 bytes each, where the result has some 4 n of them for every id).
    """
    known = edges.select(F.greatest("src", "dst").alias("i"), F.least("src", "dst").alias("j"), "dist", (F.col("src") > F.col("dst")).alias("lower"))
    best = known.groupBy("i", "j").agg(F.coalesce(F.max(F.when(F.col("lower"), F.col("dist"))), F.max("dist")).alias("dist"))
    lists = best.groupBy("i").agg(F.collect_list(F.struct("j", "dist")).alias("x")).select("i", "x.j", "x.dist")
    context = ids.sparkSession.sparkContext
    sent = context.broadcast(np.sort(ids.select(F.col("id").cast("bigint")).toArrow().column("id").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                i, near = batch.column("i")[r].as_py(), batch.column("j")[r]
                others = every[: np.searchsorted(every, i)]
                dist, absent = np.zeros(len(others)), np.ones(len(others), bool)
                if near.is_valid:
                    j, d = near.values.to_numpy(), batch.column("dist")[r].values.to_numpy(zero_copy_only=False)
                    at = np.searchsorted(others, j)
                    ok = (at < len(others)) & (others[np.minimum(at, len(others) - 1)] == j)  # neighbours that aren't among the ids have no row
                    dist[at[ok]], absent[at[ok]] = d[ok], False
                for part in (slice(k, k + 100_000) for k in range(0, len(others), 100_000)):
                    yield pa.record_batch([pa.array(np.full(len(others[part]), i)), pa.array(others[part]), pa.array(dist[part], mask=absent[part])], ["i", "j", "dist"])

    rows = ids.select(F.col("id").cast("bigint").alias("i")).join(lists, "i", "left").repartition(8 * context.defaultParallelism, "i")
    return rows.mapInArrow(run, "i bigint, j bigint, dist double")
