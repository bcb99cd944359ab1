import heapq
import math
import warnings
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions.distance import METRICS, block_distances, check_metric, distance, gradients
from nearfold.operators import edges as E
from nearfold.operators import frames, knn, weights
from nearfold.operators.components import connected_components
from nearfold.operators.dbscan import dbscan
from nearfold.operators.dendrogram import dendrogram
from nearfold.operators.embed import Alias, layout, project, resolve_batches, starting_coords
from nearfold.operators.hdbscan import core_distances, contracted, hdbscan, mutual_reachability, spanning_forest
from nearfold.operators.lof import local_outlier_factor
from nearfold.operators.joins import attach
from nearfold.operators.optics import cut, optics, settings_of, xi_clusters
from nearfold.operators.ordering import numbered
from nearfold.plans.registry import planted
from nearfold.scratch import new_path, written
from nearfold.sources import vectors as S
from nearfold.sources.index_store import search_index

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def points(spark):
    return written(planted(spark, SF), "planted")


@pytest.fixture(scope="module")
def near(points):
    return written(knn.exact_knn(points.select("id", "features"), 10), "knn")


def vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id bigint, features array<double>")


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_agree_with_expressions_and_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 4)) if metric == "hamming" else np.round(rng.normal(size=(60, 4)), 1)
    x[7] = x[8] = x[9]  # copies
    x[3] = 0
    v = vec(spark, x)
    d = block_distances(x.astype(float), x.astype(float), metric)
    pairs = v.select(F.col("id").alias("src")).join(v.select(F.col("id").alias("dst")), F.col("src") != F.col("dst"))
    for r in E.measure(pairs, v, metric).collect():
        assert abs(r.dist - d[r.src, r.dst]) < 1e-7
    want = {(i, j, k + 1) for i in range(60) for k, (_, j) in enumerate(sorted((d[i, j], j) for j in range(60) if j != i)[:5])}
    for block in (1024, 17):
        assert {(r.src, r.dst, r["rank"]) for r in knn.exact_knn(v, 5, metric, block=block).collect()} == want


def test_metrics_are_checked():
    assert check_metric("Euclidean") == "euclidean"
    with pytest.raises(ValueError):
        check_metric("chebyshev")


def test_grid_and_metric_tag(spark):
    rng = np.random.default_rng(2)
    v = vec(spark, rng.normal(size=(80, 3)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        grid = knn.search_grid(v, 5, [1, 4], [0, 1], "cosine", leaf=20)
    assert [x[:2] for x in grid] == [(1, 0), (1, 1), (4, 0), (4, 1)] and all(x[2] > 0 for x in grid) and grid[3][3] > grid[0][3]
    assert knn.metric_of(written(knn.exact_knn(v, 3, "cosine"), "knn")) == "cosine"


def test_few_vectors_and_none(spark):
    assert knn.exact_knn(vec(spark, [[1.0, 2.0]]), 3).count() == 0
    assert knn.exact_knn(vec(spark, [[0.0], [1.0], [3.0]]), 10).count() == 6
    assert knn.exact_knn(vec(spark, []), 3).count() == 0


def test_forest_search_improves_and_persists(spark):
    v = S.dense(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    exact, path = written(knn.exact_knn(v, 10), "exact"), new_path(spark, "index")
    found = {}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for trees, rounds in ((2, 0), (20, 0), (20, 1), (20, 3)):
            found[trees, rounds] = knn.recall(exact, knn.search(v, 10, trees, rounds, leaf=40, save=path)).first().recall
        assert found[2, 0] < found[20, 0] < found[20, 1] <= found[20, 3] and found[20, 3] > 0.9
        again = search_index(spark, path, 10, 3)
        assert knn.recall(exact, again).first().recall == found[20, 3]
        with pytest.raises(ValueError):
            search_index(spark, path, 10, 1, "cosine")


def test_many_copies_and_completeness(spark):
    v = vec(spark, [[1.0, 1.0]] * 50 + [[float(i), 2.0] for i in range(50)])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = knn.search(v, 5, 4, 1, leaf=10)
    assert got.filter("src = dst").count() == 0 and got.groupBy("src").count().filter("count > 5").count() == 0
    with pytest.raises(ValueError, match="no neighbours"):
        knn.check_complete(got.filter("src <> 3"), v, 5)
    with pytest.warns(UserWarning, match="fewer than"):
        knn.check_complete(got.filter("not (src = 3 and rank > 1)"), v, 5)


def test_sources(spark, tmp_path):
    with pytest.raises(TypeError):
        S.dense(spark.createDataFrame([(1, ["a"])], "id bigint, features array<string>"))
    with pytest.raises(TypeError):
        S.numeric_columns(spark.createDataFrame([(1, "a")], "id bigint, c string"), "id")
    coo = spark.createDataFrame([(0, 1, 2.0), (0, 1, 1.0), (1, 0, 5.0)], "id bigint, feature int, value double")
    rows = {r.id: r.features for r in S.from_triplets(coo, 3).collect()}
    assert rows == {0: [0, 3, 0], 1: [5, 0, 0]}
    csc = S.from_compressed(spark, [1, 0, 2], [0, 1, 3], [3.0, 5.0, 6.0], 3)
    assert {r.id: r.features for r in csc.collect()} == {0: [0, 3, 0], 1: [5, 0, 6]}
    (tmp_path / "g.tsv").write_text("# graph\n1\t2\n2\t3\t4.0\n")
    g = {(r.src, r.dst): r.weight for r in S.read_edge_list(spark, str(tmp_path / "g.tsv")).collect()}
    assert g == {(1, 2): 1, (2, 1): 1, (2, 3): 4, (3, 2): 4}
    z = S.scaled(vec(spark, [[1, 5], [3, 5]])).collect()
    assert [round(x, 6) for x in z[0].features] == [-0.707107, 0]
    assert S.scaled(vec(spark, [])).count() == 0


def test_neighbor_lists(spark, near):
    lists = E.to_neighbors(near)
    assert E.from_neighbors(lists).exceptAll(near).count() == 0 and E.count_valid(lists).first().n_edges == near.count()
    holes = spark.createDataFrame([(1, [(2, 0.1), (None, None), (3, 0.2)])], "src bigint, neighbors array<struct<dst:bigint,dist:double>>")
    assert [r.dst for r in E.from_neighbors(holes).collect()] == [2] and E.count_valid(holes).first().n_edges == 2


def test_components_against_search(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 520)] + [(7, 7), (999, 999)]
    root = list(range(1000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 3)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for p in pairs for x in p}
    assert connected_components(df.limit(0)).count() == 0


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert all(r.x + 1 == r.n for r in numbered(df.repartition(5), [F.col("x")], "n").collect())
    assert numbered(df.limit(0), [F.col("x")], "n").count() == 0


def test_weights(spark, near):
    for perplexity, power in ((4.0, 2), (4.0, 4), (50.0, 4)):
        p = written(weights.conditional(near, perplexity, power), "p")
        sums = p.groupBy("src").agg(F.sum("p").alias("s"), F.sum(-F.col("p") * F.log(F.col("p") + 1e-300)).alias("h")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in sums)
        if perplexity < 10:
            assert all(abs(r.h - math.log(perplexity)) < 1e-3 for r in sums)
        else:
            assert p.filter(F.abs(F.col("p") - 0.1) > 1e-9).count() == 0
        w = weights.symmetrize(p)
        flipped = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
        assert w.join(flipped, ["src", "dst"]).filter(F.abs(F.col("weight") - F.col("back")) < 1e-12).count() == w.count()
    assert weights.symmetrize(weights.uniform(near)).join(w.withColumnRenamed("weight", "w2"), ["src", "dst"]).filter("abs(weight - w2) > 1e-9").count() == 0
    far = spark.createDataFrame([(1, 2, 100.0), (2, 1, 50.0)], "src bigint, dst bigint, dist double")
    with pytest.warns(UserWarning):
        assert {r.dist for r in weights.rescale_overflow(far).collect()} == {1.0, 0.5}
    assert weights.rescale_overflow(near) is near


def test_gradient_constants(spark):
    d2 = np.array([5.0])  # (-1, 1) and (-2, 2): their difference is (1, -1), of squared length 2
    two = np.array([2.0])
    assert np.isclose(gradients(False, two, 1, 5.0)[0], 10 / 3 / 2.1) and np.isclose(gradients(True, two, 1, 5.0)[0], -2 / 3)
    assert np.isclose(gradients(True, two, 2, 5.0)[0], -0.8) and np.isclose(gradients(False, two, 2, 5.0)[0], 2)
    assert np.isclose(gradients(True, two, 0, 5.0)[0], -math.exp(2) / (1 + math.exp(2))) and np.isclose(gradients(False, two, 0, 5.0)[0], 5 / (1 + math.exp(2)))
    assert gradients(True, d2, 0, 5.0)[0] == -1 and gradients(False, np.array([0.0]), 2, 5.0)[0] == 0


def test_alias_and_batches():
    rng = np.random.default_rng(0)
    drawn = np.bincount(Alias(np.arange(10.0)).draw(rng, 200_000), minlength=10) / 200_000
    assert np.abs(drawn - np.arange(10) / 45).max() < 0.005
    assert resolve_batches(100, 1000, None) == 1_000_000 and resolve_batches(100, 1000, 0.5) == 500_000 and resolve_batches(100, 1000, 77) == 77
    assert resolve_batches(10**7, 1, None) == 10**11 and resolve_batches(10**6, 1, None) == 10**10
    with pytest.raises(ValueError):
        resolve_batches(1, 1, -1)


def test_embedding(spark, points, near):
    w = written(weights.edge_weights(near), "w")
    start = starting_coords(points)
    same = project(w, sgd_batches=8191, coords=start).join(start.withColumnRenamed("coords", "c"), "id")
    assert same.filter("coords <> c").count() == 0 and same.count() == 500
    label = {r.id: r.label for r in points.collect()}
    for options in ({}, {"momentum": 0.5}, {"alpha": 0.0}, {"use_degree": True, "shards": 3}, {"most_local": 10, "epochs": 8}):
        made = {r.id: r.coords for r in project(w, sgd_batches=60 * 8192, seed=2, **options).collect()}
        x = np.array([made[i] for i in sorted(made)])
        assert np.isfinite(x).all() and len(x) == 500, options
        if not options:
            assert made == {r.id: r.coords for r in project(w.repartition(3), sgd_batches=60 * 8192, seed=2).collect()}
            d = ((x[:, None] - x[None]) ** 2).sum(-1)
            np.fill_diagonal(d, np.inf)
            ids = sorted(made)
            purity = np.mean([label[ids[j]] == label[ids[i]] for i in range(500) for j in np.argsort(d[i])[:5]])
            assert purity > 0.8
    for bad in ({"momentum": 0.96}, {"sgd_batches": -1}, {"edge_sampling": "x"}):
        with pytest.raises(ValueError):
            project(w, **bad)


def test_layout(points):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = layout(points.select("id", "features"), k=8, n_trees=6, sgd_batches=2 * 8192)
    assert made.coords.count() == 500 and made.edges is not None and made.weights.count() > 0


def test_lof_finds_a_stray(spark):
    rng = np.random.default_rng(4)
    v = vec(spark, [*rng.normal(size=(60, 2)), [9.0, 9.0]])
    got = {r.id: r.lof for r in local_outlier_factor(knn.exact_knn(v, 8)).collect()}
    assert max(got, key=got.get) == 60 and got[60] > 2
    copies = local_outlier_factor(knn.exact_knn(vec(spark, [[1.0]] * 6), 3)).collect()
    assert len(copies) == 6 and all(r.lof is None for r in copies)


def test_dbscan_numbers_of_the_survey(points, near):
    for eps, clusters, noise in ((0.05, 19, 314), (0.1, 10, 53), (0.3, 10, 0)):
        got = [r.cluster for r in dbscan(near, points, eps, 5).collect()]
        assert (max(got), got.count(0)) == (clusters, noise)
    with pytest.raises(ValueError, match="Insufficient"):
        dbscan(near, points, 0.1, 11)


def sequential_optics(near, ids, eps, min_pts):
    """One heap over the whole graph, starts in order of id."""
    around, core = {}, {}
    for a, b, rank, d in near:
        if rank == min_pts - 1:
            core[a] = d if d < eps else math.inf
        if d < eps:
            around.setdefault(a, {})[b] = d
            around.setdefault(b, {})[a] = d
    reach, order, done = {}, [], set()
    for start in sorted(ids):
        heap = [(math.inf, -start)]
        while heap:
            r, p = heapq.heappop(heap)
            p = -p
            if p in done or r > reach.get(p, math.inf):
                continue
            done.add(p)
            order.append((p, r))
            if core[p] < math.inf:
                for q, d in around.get(p, {}).items():
                    new = max(core[p], d)
                    if q not in done and new < reach.get(q, math.inf):
                        reach[q] = new
                        heapq.heappush(heap, (new, -q))
    return order


def test_optics_by_component_is_the_whole(points, near):
    rows = [tuple(r) for r in near.collect()]
    ids = [r.id for r in points.collect()]
    for eps in (0.08, math.inf):
        got = [(r.id, r.reachdist) for r in optics(near, points, eps, 5, use_queue=False).orderBy("order_pos").collect()]
        assert got == sequential_optics(rows, ids, eps, 5)
    queue = [r.coredist for r in optics(near, points, 0.08, 5).orderBy("order_pos").collect()]
    assert queue[0] == math.inf and len(queue) == 500
    clusters = cut(optics(near, points, math.inf, 5, use_queue=False), 0.3, 5)
    label = {r.id: r.label for r in points.collect()}
    assert len({(r.cluster, label[r.id]) for r in clusters.collect()}) == 10
    assert any(e - s > 30 for s, e in xi_clusters(optics(near, points, math.inf, 5, use_queue=False), 0.1, 5))
    for bad in (1, 11):
        with pytest.raises(ValueError):
            optics(near, points, 1.0, bad)


def test_forest_weights_against_prim(points, near):
    mutual = written(mutual_reachability(near, core_distances(near, 5)), "mutual")
    forest = spanning_forest(mutual).collect()
    around = {}
    for u, v, w in (tuple(r) for r in mutual.collect()):
        around.setdefault(u, []).append((w, v))
        around.setdefault(v, []).append((w, u))
    done, picked = set(), []
    for start in sorted(around):
        heap = [(0.0, start)]
        while heap:
            w, p = heapq.heappop(heap)
            if p in done:
                continue
            done.add(p)
            if w:
                picked.append(w)
            for x in around[p]:
                heapq.heappush(heap, x)
    assert sorted(r.weight for r in forest) == sorted(picked) and len(forest) == 490


def test_hdbscan_on_many_roots_and_on_one(spark, points, near):
    label = {r.id: r.label for r in points.collect()}
    for edges in (near, knn.exact_knn(points.select("id", "features"), 80)):
        for stability in ("inclusive", "paper"):
            got = hdbscan(written(edges, "e"), points, 20, 5, stability)
            rows = got.points.collect()
            assert len(rows) == 500 and len({(r.cluster, label[r.id]) for r in rows}) == 10 and all(r.cluster for r in rows)
            assert all(0 <= r.glosh <= 1 and 0 <= r.probability <= 1 for r in rows)
    clusters = got.clusters.collect()
    roots = [c for c in clusters if c.parent is None]
    assert len(roots) == 1 and not roots[0].selected and len(clusters) == 19
    v = S.dense(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    plain = hdbscan(written(knn.exact_knn(v, 20), "e"), v, 20, 5).points
    assert plain.filter("cluster is null").count() == 500
    tree = dendrogram(got, include_nodes=True).collect()
    top = [r for r in tree if r.parent_id is None]
    assert len(top) == 1 and top[0].members == 500 and sum(r.leaf for r in tree) == 500
    short = {r.node_id: r for r in dendrogram(got).collect()}
    assert sum(r.members for r in short.values() if r.leaf) == 500
    assert all(short[r.parent_id].height >= r.height for r in short.values() if r.parent_id)


def test_frames(spark, points, near):
    xy = points.select("id", F.col("features").alias("coords"))
    frame = frames.cluster_frame(hdbscan(near, points, 20, 5), xy, near).collect()
    assert len(frame) == 500 and sum(r.parent is None for r in frame) == 10 and all(r.distance is not None for r in frame if r.parent is not None)
    cells = frames.grid_frame(xy).collect()
    assert len(cells) == 100 == len({r.id for r in cells}) == len({(r.cell_x, r.cell_y) for r in cells})
    image = xy.select("id", F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("layers"), F.array(*(F.lit(float(k)) for k in range(4))).alias("pixels"))
    got = frames.mosaic_frame(xy, image, n=7).collect()
    assert len(got) == 7 and got[0].pixels == [1.0, 1 - 1 / 3, 1 - 2 / 3, 0.0]
    with pytest.raises(ValueError):
        frames.mosaic_frame(xy, image.limit(3))
    with pytest.raises(ValueError):
        frames.mosaic_frame(xy, image.withColumn("layers", F.lit(5)))
    with pytest.raises(ValueError):
        frames.grid_frame(xy.select("id", F.array(F.lit(1.0)).alias("coords")))


def test_distance_table_has_nulls(spark):
    e = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.6), (1, 3, 0.7)], "src bigint, dst bigint, dist double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    got = {(r.i, r.j): r.dist for r in E.distance_table(e, ids).collect()}
    assert got == {(2, 1): 0.5, (3, 1): 0.7, (3, 2): None}
    assert len(list(combinations(range(3), 2))) == 3 and distance is not None


def test_forest_by_contraction(spark, near):
    """Rounds of contraction give the same forest, and leave no task more edges than asked for."""
    mutual = written(mutual_reachability(near, core_distances(near, 5)), "mutual")
    whole = sorted(spanning_forest(mutual).collect())
    for most in (1000, 0):
        chosen, rest = contracted(mutual, most)
        assert chosen and rest.count() <= most < mutual.count()
    assert sorted(spanning_forest(mutual, most_local=100).collect()) == whole
    assert len(whole) == 490 and spanning_forest(mutual.limit(0), most_local=0).count() == 0


def test_hot_keys_are_attached(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    groups = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "groups")
    got = attach(rows, groups, ["k"], "n", hot_least=50)
    assert got.count() == 500 and got.filter("top is null or (k = 7 and top <> 498) or (k <> 7 and top <> k)").count() == 0


def test_large_leaves_lose_no_pair(spark):
    """One leaf that holds all vectors, most of them copies, cut into parts: the same as exact search."""
    v = vec(spark, [[0.5, 0.5]] * 40 + [[float(i % 13), float(i % 7)] for i in range(80)])
    leaves = written(v.select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("tree"), F.lit(0).cast("bigint").alias("leaf")), "leaves")
    exact = sorted(map(tuple, knn.exact_knn(v, 6).collect()))
    for most, at_once in ((9, 2), (4096, 8)):
        assert sorted(map(tuple, knn.forest_knn(leaves, v, 6, most=most, trees_at_once=at_once).collect())) == exact


def test_vectors_are_checked(spark):
    good = vec(spark, [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]])
    assert knn.checked(good) == (3, 2) and knn.checked(good.limit(0)) == (0, 0)
    infinite = "if(id = 1, array(1D, CAST('Infinity' AS DOUBLE)), features) AS features"
    for what, bad in {
        "without an id": ["nullif(id, 1) AS id", "features"], "another has": ["1L AS id", "features"], "without a vector": ["id", "if(id = 1, NULL, features) AS features"],
        "not finite": ["id", infinite], "1 to 2 elements": ["id", "if(id = 1, array(1D), features) AS features"],
    }.items():
        for call in (lambda x: knn.exact_knn(x, 1), lambda x: knn.search(x, 1, 2)):
            with pytest.raises(ValueError, match=what):
                call(good.selectExpr(*bad))


def test_layouts_are_taken(points, near):
    class Made:
        coords, edges = points.select("id", F.col("features").alias("coords")), near

    assert sorted(dbscan(Made, eps=0.1, min_pts=5).collect()) == sorted(dbscan(near, points, 0.1, 5).collect())
    assert local_outlier_factor(Made).count() == 500
    made = optics(Made, eps=0.1, min_pts=5)
    assert made.count() == 500 and settings_of(made) == {"min_pts": 5, "eps": 0.1} and settings_of(cut(made, 0.05, 3)) == {"eps_cl": 0.05}
    Made.edges = None
    with pytest.raises(ValueError):
        dbscan(Made)
