"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.settle import settle


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of `n` items, given pairs of linked indexes."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for ends in (left, right):
            np.minimum.at(root, root[ends], low)
            np.minimum.at(root, ends, low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        if np.array_equal(root, before):
            break
    return root


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another one; component is its smallest reachable node.

    A hub with any number of edges is only ever reduced by an aggregate or joined to one row (its smallest
    neighbour), so a hot node never has to fit in a task. Minima are written before they are joined: both sides of
    the join are then plain exchanges, whose hot partitions AQE may split. Every round is written to the shared folder.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = settle(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
