"""Dendrogram of a condensed hierarchy, as a table of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.hdbscan import Hdbscan

SCHEMA = "node_id string, parent_id string, height double, members bigint, leaf boolean, label string, midpoint double, position int"


def root_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters without a parent."""
    return clusters.filter("parent is null").select("cluster")


def dendrogram(result: Hdbscan, include_nodes: bool = False, most: int = 1_000_000) -> DataFrame:
    """(node_id, parent_id, height, members, leaf, label, midpoint, position).

    Points that belong to a cluster immediately are leaves of their own (include_nodes), or one leaf "n points" for all of
    them. Children are in order of height. A cluster stands at 1 / lambda_birth, a root, which has none, at 1.1 times its highest child;
    several roots hang under a super-root at 1.2 times the highest. A label has the stability, and * if selected. The table of
    clusters, which is small beside the points, is walked on the driver (ValueError beyond `most`); points are attached by a join.
    """
    rows = result.clusters.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters")
    own = {r.membership: (r.n, r.top) for r in result.points.filter("membership is not null").groupBy("membership").agg(F.count("*").alias("n"), F.max("lambda").alias("top")).collect()}
    below: dict[int | None, list[int]] = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r.cluster)
    nodes: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: -r.cluster):  # children have larger numbers
        kids = [f"c{k}" for k in below.get(r.cluster, [])]
        n, top = own.get(r.cluster, (0, 0.0))
        if n:
            name = f"p{r.cluster}"
            nodes[name] = {"height": 1 / top if top else 0.0, "members": n, "leaf": True, "label": f"{n} point" + "s" * (n > 1), "width": n if include_nodes else 1, "midpoint": 0.0, "kids": []}
            kids.append(name)
        kids.sort(key=lambda x: (nodes[x]["height"], x))
        highest = max((nodes[x]["height"] for x in kids), default=0.0)
        nodes[f"c{r.cluster}"] = {
            "height": 1 / r.lambda_birth if r.lambda_birth else 1.1 * highest, "members": sum(nodes[x]["members"] for x in kids), "leaf": False,
            "label": f"{r.stability:.4g}" + "*" * bool(r.selected), "kids": kids,
        }
    tops = [f"c{k}" for k in below.get(None, [])]
    if len(tops) > 1:
        tops.sort(key=lambda x: (nodes[x]["height"], x))
        nodes["root"] = {"height": 1.2 * max(nodes[x]["height"] for x in tops), "members": sum(nodes[x]["members"] for x in tops), "leaf": False, "label": "", "kids": tops}
    for name in sorted(nodes, key=lambda x: (x == "root", x[0] == "c", -int(x[1:]) if x != "root" else 0)):
        x = nodes[name]
        if x["kids"]:
            x["width"] = sum(nodes[k]["width"] for k in x["kids"])
            first, last = nodes[x["kids"][0]], nodes[x["kids"][-1]]
            x["midpoint"] = (first["midpoint"] + x["width"] - last["width"] + last["midpoint"]) / 2
        x.setdefault("width", 1)
        x.setdefault("midpoint", 0.0)
    up = {k: (name, i) for name, x in nodes.items() for i, k in enumerate(x["kids"])}
    table = [(k, up.get(k, (None, 0))[0], float(x["height"]), int(x["members"]), x["leaf"], x["label"], float(x["midpoint"]), up.get(k, (None, 0))[1]) for k, x in nodes.items()]
    frame = result.points.sparkSession.createDataFrame(table, SCHEMA)
    if not include_nodes:
        return frame
    inner = frame.filter("not leaf")
    points = result.points.filter("membership is not null").select(
        F.concat(F.lit("point"), "id").alias("node_id"), F.concat(F.lit("c"), "membership").alias("parent_id"), (1 / F.col("lambda")).alias("height"), F.lit(1).cast("bigint").alias("members"),
        F.lit(True).alias("leaf"), F.col("id").cast("string").alias("label"), F.lit(0.0).alias("midpoint"), F.lit(0).alias("position"),
    )
    return inner.unionByName(points)
