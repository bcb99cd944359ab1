import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import nearest
from nearfold.functions.distance import METRICS, block_distances
from nearfold.functions.nearest import Nearest
from nearfold.operators import edges as E
from nearfold.operators import knn
from nearfold.scratch import written


def vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id bigint, features array<double>")


def kinds(rng, n):
    yield "normal", rng.normal(size=(n, 64))
    yield "odd size", rng.normal(size=(n, 11))
    yield "plane", rng.normal(size=(n, 2))
    yield "far off", rng.normal(size=(n, 3)) * 1e-3 + 1e5
    yield "ties", rng.integers(-2, 3, (n, 9)).astype(float)
    yield "copies", np.repeat(rng.normal(size=(3, 20)), n // 3, axis=0)
    yield "outliers", rng.normal(size=(n, 8)) * 10.0 ** rng.integers(-6, 7, (n, 1))


@pytest.mark.parametrize("metric", METRICS)
def test_bounds_lose_nobody(metric):
    rng = np.random.default_rng(5)
    for what, x in kinds(rng, 300):
        if metric == "cosine" and what == "far off":
            continue  # all alike but for rounding
        ids = rng.permutation(300) * 3
        found = Nearest(ids[:100], x[:100], 7, metric)
        for part in (slice(0, 20), slice(20, 150), slice(150, 300)):
            found.add(ids[part], x[part])
        d = block_distances(x[:100], x, metric)
        for i in range(100):
            d[i, i] = np.inf
            want = np.lexsort((ids, np.round(d[i], 9)))[:7]
            assert np.allclose(found.dist[i], np.sort(d[i])[:7], rtol=1e-9, atol=1e-7), (what, i)
            if what in ("normal", "odd size", "plane"):
                assert found.near[i].tolist() == ids[want].tolist(), (what, i)


@pytest.mark.parametrize("metric", ("euclidean", "cosine", "manhattan"))
def test_few_pairs_are_computed_exactly(metric, monkeypatch):
    rng, seen, whole = np.random.default_rng(6), [], nearest.pair_distances
    monkeypatch.setattr(nearest, "pair_distances", lambda q, x, m: seen.append(len(q)) or whole(q, x, m))
    x = rng.normal(size=(6000, 64))
    found = Nearest(np.arange(1000), x[:1000], 10, metric)
    found.add(np.arange(6000), x)
    assert sum(seen) < 0.1 * 1000 * 6000


def test_negative_elements_differ_in_bits_as_columns_do(spark):
    x = np.array([[-1.0, 2.0], [1.0, -3.0], [0.0, 5.0]])
    d = block_distances(x, x, "hamming")
    pairs = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "src bigint, dst bigint")
    assert all(r.dist == d[r.src, r.dst] for r in E.measure(pairs, vec(spark, x), "hamming").collect())


def test_partners_in_the_plane_follow_the_points(spark):
    """Each block meets as many others, however many there are; and what comes out is exact, with copies and strays."""
    rng, partners = np.random.default_rng(7), {}
    for n in (4000, 16_000):
        v = written(vec(spark, rng.normal(size=(n, 2))), "v")
        cells = written(knn._cells(v, n, 100), "cells")
        packed = written(knn._packed(cells.withColumnRenamed("leaf", "block"), 5, "euclidean", True), "packed")
        assert packed.agg(F.sum(F.length("id"))).first()[0] == 8 * n
        partners[n] = knn._partners(packed, "euclidean").count() / n
    assert partners[16_000] < 1.5 * partners[4000]
    x = np.concatenate([rng.normal(size=(1500, 2)), np.repeat(rng.normal(size=(4, 2)), 150, axis=0), [[50.0, 50.0], [-90.0, 3.0]]])
    for metric in ("euclidean", "manhattan"):
        d = block_distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        want = {(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])}
        assert {(r.src, r.dst, r["rank"]) for r in knn.exact_knn(vec(spark, x), 5, metric, block=60).collect()} == want


def test_distance_table_shuffles_no_pair(spark):
    """All pairs, with nulls, from a plan whose exchanges have no more rows than there are ids and edges."""
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 300, 900), rng.integers(0, 300, 900), rng.random(900)) if a != b}
    edges |= {(7, 999): 0.1, (999, 7): 0.2}  # not among the ids
    e = written(spark.createDataFrame([(a * 5, b * 5, w) for (a, b), w in edges.items()], "src bigint, dst bigint, dist double"), "e")
    made = E.distance_table(e, written(spark.range(0, 1500, 5), "ids"))
    got = {(r.i, r.j): r.dist for r in made.collect()}
    want = {(5 * a, 5 * b): edges.get((a, b), edges.get((b, a))) for a in range(300) for b in range(a)}
    assert got == want and len(got) == 300 * 299 // 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_a_goal_is_reached_where_the_leaves_alone_fail(spark):
    rng = np.random.default_rng(9)
    v = written(vec(spark, rng.normal(size=(3000, 24))), "v")
    exact, found = written(knn.exact_knn(v, 10), "exact"), {}
    for trees, leaf, goal in ((6, 20, None), (6, 20, 0.9), (2, 20, 0.9)):
        found[trees, goal] = knn.recall(exact, knn.search(v, 10, trees, 0, leaf=leaf, goal=goal)).first().recall
    assert found[6, None] < 0.5 and found[6, 0.9] >= 0.9 and found[2, 0.9] >= 0.9
    x, near = knn.sampled_truth(v, 10, "euclidean", 3000)
    truth = {(tuple(np.round(x[a], 9)), tuple(np.round(x[b], 9))) for a, b in near}
    rows = np.round(np.array([r.features for r in v.orderBy("id").collect()]), 9)
    assert 300 < len(near) // 10 < 700 and truth <= {(tuple(rows[r.src]), tuple(rows[r.dst])) for r in exact.collect()}
