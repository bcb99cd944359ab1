"""HDBSCAN* over a neighbour graph: spanning forest, condensed hierarchy, clusters, probabilities, outlier scores."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.components import connected_components
from nearfold.operators.dbscan import check_neighbors, graph_of
from nearfold.operators.edges import undirected
from nearfold.operators.joins import attach
from nearfold.operators.ordering import numbered
from nearfold.scratch import written


def core_distances(edges: DataFrame, k: int) -> DataFrame:
    """(id, core_distance): distance to the k-th neighbour; zero, as among copies, is raised to the reverse distance or 1e-5."""
    near = edges.filter(F.col("rank") == k)
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("dist").alias("back"))
    least = F.greatest(F.coalesce("back", F.lit(0.0)), F.lit(1e-5))
    return near.join(back, ["src", "dst"], "left").select(F.col("src").alias("id"), F.when(F.col("dist") == 0, least).otherwise(F.col("dist")).alias("core_distance"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, weight) for u > v of the undirected graph: the largest of both core distances and the distance."""
    both = undirected(edges).filter("src > dst")
    a = core.select(F.col("id").alias("src"), F.col("core_distance").alias("ca"))
    b = core.select(F.col("id").alias("dst"), F.col("core_distance").alias("cb"))
    return both.join(a, "src").join(b, "dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.greatest("ca", "cb", "dist").alias("weight"))


def point_lambda(mutual: DataFrame) -> DataFrame:
    """(id, lambda): one by the least mutual reachability of any edge at the point."""
    ends = mutual.select(F.col("u").alias("id"), "weight").unionByName(mutual.select(F.col("v").alias("id"), "weight"))
    return ends.groupBy("id").agg((1 / F.min("weight")).alias("lambda"))


def _kruskal(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the forest's edges between a and b, in the order (w, u, v)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    root, kept = list(range(len(ids))), []
    for k in np.lexsort((v, u, w)).tolist():
        x, y = one[k], other[k]
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def contracted(mutual: DataFrame, most_local: int) -> tuple[list[DataFrame], DataFrame]:
    """(edges of the forest, what is left): rounds of joining every tree to the nearest other, until at most `most_local` edges are left.

    What is left is (a, b, u, v, weight): of the edges (u, v) between two trees a and b the least. A round at least halves the trees that
    have edges, and costs a few aggregations and joins; no task holds more than its share of the edges.
    """
    now = written(mutual.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "weight"), "edges")
    chosen: list[DataFrame] = []
    while now.count() > most_local:
        edge = F.struct("weight", "u", "v", "a", "b").alias("e")
        ends = now.select(F.col("a").alias("tree"), edge).unionByName(now.select(F.col("b").alias("tree"), edge))
        best = written(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "nearest")
        if best.isEmpty():
            break
        chosen.append(best.select("u", "v", "weight"))
        tree = written(connected_components(best, "a", "b"), "trees")
        of = lambda c: tree.select(F.col("node").alias(c), F.col("component").alias(f"{c}2"))  # noqa: B023, E731
        moved = now.join(of("a"), "a").join(of("b"), "b").filter("a2 <> b2")
        least = moved.groupBy(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min(F.struct("weight", "u", "v")).alias("e"))
        now = written(least.select("a", "b", "e.u", "e.v", "e.weight"), "edges")
    return chosen, now


def spanning_forest(mutual: DataFrame, component: DataFrame | None = None, most_local: int = 2_000_000) -> DataFrame:
    """(component, u, v, weight): the minimum spanning forest, unique by the order (weight, u, v).

    Rounds of contraction leave at most `most_local` edges in all, which are then reduced per component, each in one task. Either way
    gives the same forest.
    """
    comp = component if component is not None else connected_components(mutual, "u", "v")
    of = comp.select(F.col("node").alias("u"), "component")
    chosen, rest = contracted(mutual, most_local)
    columns, schema = ["component", "u", "v", "weight"], "component bigint, u bigint, v bigint, weight double"

    def last(f: pd.DataFrame) -> pd.DataFrame:
        return f.iloc[_kruskal(*(f[c].to_numpy() for c in ("a", "b", "u", "v", "weight")))][columns]

    forest = rest.join(of, "u").groupBy("component").applyInPandas(last, schema)
    for x in chosen:
        forest = forest.unionByName(x.join(of, "u").select(*columns))
    return forest


class _Node:
    __slots__ = ("size", "birth", "death", "left", "right", "fallen", "total", "stability", "selected", "point")

    def __init__(self, size: int, death: float = 0.0, point: int | None = None):
        self.size, self.birth, self.death, self.point = size, 0.0, death, point
        self.left = self.right = None
        self.fallen: list[tuple[int, float]] = []
        self.total = self.stability = 0.0
        self.selected = False


def _absorb(node: _Node, child: _Node) -> None:
    """A child's points fall into the node, each keeping the lambda of its own first merge."""
    if child.point is not None:
        child.fallen, child.total = [(child.point, child.birth)], child.birth
    node.total += child.total
    if len(child.fallen) > len(node.fallen):
        node.fallen, child.fallen = child.fallen, node.fallen
    node.fallen += child.fallen


def hierarchy(edges: list[tuple[int, int, float]], min_pts: int, single_root: bool, paper: bool = False) -> list[_Node]:
    """Condensed clusters of one component in pre-order, from its forest's edges in order of weight.

    A side of a split that has fewer than min_pts points dissolves into its parent; a cluster of which one side is left goes on
    in it. paper: stability as published, else internal clusters count their children's points from lambda 0.
    """
    points: dict[int, _Node] = {}
    root: dict[int, int] = {}
    top: dict[int, _Node] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order, last = [], None
    for u, v, w in edges:
        for x in (u, v):
            if x not in points:
                points[x] = top[x] = _Node(1, point=x)
                root[x] = x
        a, b = find(u), find(v)
        x, y = top[a], top[b]
        node = _Node(x.size + y.size, 1 / w)
        x.birth = y.birth = node.death
        node.left, node.right = (x, y) if x.size < y.size else (y, x)
        root[a] = b
        top[b] = last = node
        order.append(node)
    for node in order:  # children come before parents
        if node.left.size < min_pts:
            small, large = node.left, node.right
            _absorb(node, small)
            _absorb(node, large)
            if large.size < min_pts:
                node.left = node.right = None
            else:
                node.death = max(node.death, large.death)
                node.left, node.right = large.left, large.right
    pre, stack = [], [last]
    while stack:
        node = stack.pop()
        pre.append(node)
        if node.left is not None:
            stack += [node.right, node.left]
    for node in reversed(pre):
        node.stability = node.total - node.birth * len(node.fallen)
        if node.left is None:
            node.selected = node.size >= min_pts and not (single_root and node is last)
            continue
        children = node.left.stability + node.right.stability
        inner = node.left.size + node.right.size
        own = node.stability if single_root and node is last else node.stability + (node.death - (node.birth if paper else 0.0)) * inner
        if own > children and not (single_root and node is last):
            node.stability, node.selected = own, True
            below = [node.left, node.right]
            while below:
                x = below.pop()
                if x.selected:
                    x.selected = False
                elif x.left is not None:
                    below += [x.left, x.right]
        else:
            node.stability = max(own, children) if single_root and node is last else children
    return pre


OUT = (
    "kind string, component bigint, id bigint, node int, lambda double, chosen int, mst_parent bigint, parent int, stability double, selected boolean, "
    "lambda_birth double, lambda_death double, size bigint, first bigint"
)


def _component(frame: pd.DataFrame, min_pts: int, single_root: bool, paper: bool) -> pd.DataFrame:
    frame = frame.sort_values(["weight", "u", "v"])
    comp = int(frame.component.iloc[0])
    edges = list(zip(frame.u.tolist(), frame.v.tolist(), frame.weight.tolist()))
    around: dict[int, list[int]] = {}
    for u, v, _ in edges:
        around.setdefault(u, []).append(v)
        around.setdefault(v, []).append(u)
    start = min(around)
    parent, queue = {start: None}, deque([start])
    while queue:
        x = queue.popleft()
        for y in around[x]:
            if y not in parent:
                parent[y] = x
                queue.append(y)
    rows = []
    pre = hierarchy(edges, min_pts, single_root, paper)
    number = {id(n): k for k, n in enumerate(pre)}
    up, chosen = {}, {}
    for k, n in enumerate(pre):
        p = up.get(id(n))
        chosen[k] = k if n.selected else chosen.get(p)
        first = min((i for i, _ in n.fallen), default=None)
        rows.append(("cluster", comp, None, k, None, chosen[k], None, p, n.stability, n.selected, n.birth, n.death, n.size, first))
        rows += [("point", comp, i, k, lam, chosen[k], parent[i], None, None, None, None, None, None, None) for i, lam in n.fallen]
        for child in (n.left, n.right):
            if child is not None:
                up[id(child)] = number[id(n)]
    table = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
    return table.astype(dict.fromkeys(["id", "node", "chosen", "mst_parent", "parent", "size", "first"], "Int64"))


@dataclass
class Hdbscan:
    """points: id, cluster (null for outliers), probability, glosh, mst_parent, membership, lambda, core_distance.
    clusters: cluster, parent, stability, selected, lambda_birth, lambda_death, size.
    """

    points: DataFrame
    clusters: DataFrame


def hdbscan(edges, ids: DataFrame | None = None, min_pts: int = 20, k: int = 5, stability: str = "inclusive") -> Hdbscan:
    """Hierarchical density clusters. Flat clusters are numbered by their smallest point, condensed ones by component and pre-order.

    edges may be a Layout. A point without any edge is an outlier without hierarchy. Where the graph is one component its root is never selected.
    """
    if stability not in ("inclusive", "paper"):
        raise ValueError(f"stability {stability!r}")
    edges, ids = graph_of(edges, ids)
    check_neighbors(edges, k)
    core = written(core_distances(edges, k), "core")
    mutual = written(mutual_reachability(edges, core), "mutual")
    comp = written(connected_components(mutual, "u", "v"), "components")
    roots = comp.select("component").distinct().limit(2).count()
    forest = written(spanning_forest(mutual, comp), "forest")
    single, paper = roots == 1, stability == "paper"
    found = written(forest.groupBy("component").applyInPandas(lambda f: _component(f, min_pts, single, paper), OUT), "hierarchy")
    clusters = numbered(found.filter("kind = 'cluster'"), [F.col("component"), F.col("node")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    named = written(clusters, "clusters")
    number = named.select("component", F.col("node"), F.col("cluster").alias("number"))
    table = named.join(number.withColumnRenamed("node", "parent").withColumnRenamed("number", "above"), ["component", "parent"], "left").select(
        "cluster", F.col("above").alias("parent"), "stability", "selected", "lambda_birth", "lambda_death", "size"
    )
    points = found.filter("kind = 'point'").select("component", "id", "node", "lambda", "chosen", "mst_parent").join(number, ["component", "node"])
    flat = points.filter("chosen is not null").groupBy("component", "chosen").agg(F.min("id").alias("first"))
    flat = numbered(flat, [F.col("first")], "flat").select("component", "chosen", F.col("flat").cast("int").alias("cluster"))
    joined = points.join(flat, ["component", "chosen"], "left")
    joined = written(joined, "points")
    # outliers have no cluster, and nothing is asked of all of them
    ranges = joined.filter("cluster is not null").groupBy("cluster").agg(F.min("lambda").alias("low"), F.max("lambda").alias("high"), F.count("*").alias("n"))
    tops = joined.groupBy("number").agg(F.max("lambda").alias("top"), F.count("*").alias("n"))
    inside = attach(joined.filter("cluster is not null"), written(ranges, "ranges"), ["cluster"], "n").drop("n")
    both = inside.unionByName(joined.filter("cluster is null"), allowMissingColumns=True)
    ranged = attach(both, written(tops, "tops"), ["number"], "n")
    low, high, top = F.col("low"), F.col("high"), F.col("top")
    scored = ranged.select(
        "id", "cluster", F.when(F.col("cluster").isNull(), F.col("lambda")).otherwise(F.try_divide(F.col("lambda") - low, high - low)).alias("probability"),
        F.try_divide(top - F.col("lambda"), top).alias("glosh"), "mst_parent", F.col("number").alias("membership"), "lambda",
    )
    return Hdbscan(ids.select("id").join(scored, "id", "left").join(core, "id", "left"), table)
