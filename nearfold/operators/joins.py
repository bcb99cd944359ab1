"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_share: float = 1e-3, hot_least: int = 20_000) -> DataFrame:
    """Left join of rows to groups, which has one row per value of the non-null keys and the number of rows in `size`.

    Keys of more than hot_share of all rows are at most 1 / hot_share keys: that bounded set is broadcast, so their rows never
    meet in one task. All other keys join by sort-merge, each with at most hot_share of the rows. Nothing is dropped.
    `groups` is read twice and should be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(hot_least, int(total * hot_share))
    cold = groups.filter(F.col(size) <= least)
    if total <= least or groups.filter(F.col(size) > least).isEmpty():
        return rows.join(cold.hint("merge"), keys, "left")
    hot = F.broadcast(groups.filter(F.col(size) > least))
    rest = rows.join(F.broadcast(groups.filter(F.col(size) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold.hint("merge"), keys, "left"))
