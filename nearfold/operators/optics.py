"""OPTICS over a neighbour graph."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.operators.components import connected_components
from nearfold.operators.dbscan import check_neighbors, graph_of
from nearfold.operators.edges import undirected
from nearfold.operators.ordering import numbered
from nearfold.scratch import written

INF = float("inf")


def core_distances(edges: DataFrame, ids: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(id, coredist): distance to the neighbour of rank min_pts - 1 if that is below eps, else infinity."""
    near = edges.filter(F.col("rank") == min_pts - 1).select(F.col("src").alias("id"), "dist")
    return ids.select("id").join(near, "id", "left").select("id", F.when(F.col("dist") < eps, F.col("dist")).otherwise(F.lit(INF)).alias("coredist"))


def _walk(frame: pd.DataFrame, start_order: str) -> pd.DataFrame:
    """Orders one component: from each start the nearest reachable point next, of equal ones the larger id."""
    points = frame[frame.dst.isna()]
    core = dict(zip(points.src.tolist(), points.dist.tolist()))
    near: dict[int, list] = {}
    for a, b, d in frame[frame.dst.notna()][["src", "dst", "dist"]].itertuples(index=False):
        near.setdefault(a, []).append((int(b), d))
    key = {"row": lambda p: p, "core_desc": lambda p: (-core[p], -p), "core_asc": lambda p: (core[p], p)}[start_order]
    reach, before, out, done = dict.fromkeys(core, INF), {}, [], set()
    for start in sorted(core, key=key):
        if start in done:
            continue
        heap = [(INF, -start)]
        while heap:
            r, p = heapq.heappop(heap)
            p = -p
            if p in done or r > reach[p]:
                continue
            done.add(p)
            out.append((p, start, core[start], len(out), reach[p], core[p], before.get(p)))
            if core[p] == INF:
                continue
            for q, d in near.get(p, ()):
                new = max(core[p], d)
                if q not in done and new < reach[q]:
                    reach[q], before[q] = new, p
                    heapq.heappush(heap, (new, -q))
    table = pd.DataFrame(out, columns=["id", "start", "start_core", "pos", "reachdist", "coredist", "predecessor"])
    return table.astype({"predecessor": "Int64"})


def optics(edges, ids: DataFrame | None = None, eps: float = INF, min_pts: int | None = None, use_queue: bool = True, start_order: str | None = None) -> DataFrame:
    """(id, order_pos, reachdist, coredist, predecessor). start_order: row, core_desc (the default with use_queue) or core_asc.

    Components of the graph below eps are ordered each in a task of its own, which holds one component's edges, and then
    joined in the order of their starting points. edges may be a Layout. settings_of gives what the ordering was made with.
    """
    edges, ids = graph_of(edges, ids)
    k = check_neighbors(edges, min_pts or 2)
    min_pts = min_pts or k
    if min_pts < 2:
        raise ValueError("minPts must be >= 2")
    order = start_order or ("core_desc" if use_queue else "row")
    if order not in ("row", "core_desc", "core_asc"):
        raise ValueError(f"start_order {order!r}")
    region = written(undirected(edges).filter(F.col("dist") < eps), "region")
    core = written(core_distances(edges, ids, eps, min_pts), "core")
    linked = connected_components(region).select(F.col("node").alias("id"), "component")
    placed = written(ids.select("id").join(linked, "id", "left").select(F.col("id").alias("src"), F.coalesce("component", "id").alias("component")), "placed")
    rows = region.join(placed, "src").unionByName(core.select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("coredist").alias("dist")).join(placed, "src"))
    schema = "id bigint, start bigint, start_core double, pos bigint, reachdist double, coredist double, predecessor bigint"
    walked = rows.groupBy("component").applyInPandas(lambda f: _walk(f, order), schema)
    keys = {"row": ["start", "pos"], "core_desc": [F.desc("start_core"), F.desc("start"), "pos"], "core_asc": ["start_core", "start", "pos"]}[order]
    return numbered(walked, [F.col(x) if isinstance(x, str) else x for x in keys], "order_pos").select("id", "order_pos", "reachdist", "coredist", "predecessor").withMetadata("order_pos", {"min_pts": min_pts, "eps": str(eps)})


def settings_of(ordering: DataFrame) -> dict:
    """min_pts and eps of an ordering, and eps_cl of clusters cut from one, as far as it tells."""
    found = {k: v for f in ordering.schema for k, v in f.metadata.items()}
    return {k: float(v) if k != "min_pts" else int(v) for k, v in found.items() if k in ("min_pts", "eps", "eps_cl")}


def cut(ordering: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(id, cluster) of an ordering: a new run begins where a point has no predecessor or is farther than eps; runs of fewer than min_pts are noise (0).

    Runs are counted within ranges of 100,000 positions and carried on from range to range, so only the ranges meet in one task.
    """
    first = F.col("predecessor").isNull() | (F.col("reachdist") > eps)
    span = 100_000
    ranged = ordering.withColumn("range", F.floor((F.col("order_pos") - 1) / span)).withColumn("first", first.cast("int"))
    within = Window.partitionBy("range").orderBy("order_pos")
    sums = ranged.groupBy("range").agg(F.sum("first").alias("n"))
    carried = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = ranged.withColumn("in_range", F.sum("first").over(within)).join(carried.select("range", "before"), "range").withColumn("run", F.col("in_range") + F.col("before"))
    sizes = runs.groupBy("run").agg(F.count("*").alias("size")).filter(F.col("size") >= min_pts)
    numbers = numbered(sizes.select("run"), [F.col("run")], "cluster")
    return runs.join(numbers, "run", "left").select("id", F.coalesce("cluster", F.lit(0)).cast("int").alias("cluster")).withMetadata("cluster", {"eps_cl": str(eps)})


def reachability_plot(ordering: DataFrame, label: str) -> DataFrame:
    """(order_pos, reachdist, label): what a reachability plot shows; infinite distances are null."""
    return ordering.select("order_pos", F.when(F.col("reachdist") < INF, F.col("reachdist")).alias("reachdist"), F.lit(label).alias("label"))


def xi_clusters(ordering: DataFrame, xi: float, min_pts: int) -> list[tuple[int, int]]:
    """Start and end positions of clusters between steep areas of the reachability plot, by the published method. For plots that fit the driver."""
    rows = ordering.orderBy("order_pos").select("reachdist").limit(5_000_001).collect()
    if len(rows) > 5_000_000:
        raise ValueError("too long an ordering for steep areas on the driver; cut it at a distance instead")
    r = [x[0] for x in rows] + [INF]
    n, down, found, mib, i = len(rows), [], [], 0.0, 0
    ratio = 1 - xi
    falls = lambda k: r[k] * ratio >= r[k + 1] if r[k] != INF else r[k + 1] != INF
    rises = lambda k: r[k] <= r[k + 1] * ratio if r[k + 1] != INF else r[k] != INF

    def extent(k: int, steep, right) -> int:
        end, flat = k, 0
        while k < n:
            if steep(k):
                end, flat = k, 0
            elif not right(k) or (flat := flat + 1) > min_pts:
                break
            k += 1
        return end

    def prune(m: float) -> None:
        down[:] = [d for d in down if m <= r[d["start"]] * ratio or r[d["start"]] == INF]
        for d in down:
            d["mib"] = max(d["mib"], m)

    while i < n:
        mib = max(mib, r[i])
        if falls(i):
            prune(mib)
            end = extent(i, falls, lambda k: r[k] >= r[k + 1])
            down.append({"start": i, "end": end, "mib": 0.0})
            i = end + 1
            mib = r[i] if i < n else 0.0
        elif rises(i):
            prune(mib)
            end = extent(i, rises, lambda k: r[k] <= r[k + 1])
            for d in down:
                top = r[end + 1]
                if top * ratio < d["mib"]:
                    continue
                s, e = d["start"], end
                if r[s] * ratio >= top:
                    while s < d["end"] and r[s + 1] > top:
                        s += 1
                elif top * ratio >= r[s]:
                    while e > i and r[e] > r[s]:
                        e -= 1
                if e - s + 1 >= min_pts:
                    found.append((s + 1, e + 1))
            i = end + 1
            mib = r[i] if i < n else 0.0
        else:
            i += 1
    return found
