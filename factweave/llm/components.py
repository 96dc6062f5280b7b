"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Forest:
    """The trees of n members that links have joined so far; a link inside a tree is left out."""

    def __init__(self, n: int):
        self.tree, self.trees = np.arange(n), n

    def joined(self, i: int, others: np.ndarray) -> np.ndarray:
        """Join i with others; returns those that were in trees apart from i's and from each other's."""
        others = others[self.tree[others] != self.tree[i]]
        if not len(others):
            return others
        apart, first = np.unique(self.tree[others], return_index=True)
        for t in apart.tolist():
            self.tree[self.tree == t] = self.tree[i]
        self.trees -= len(apart)
        return others[first]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them: the larger neighbours (large), or the smaller ones with the node itself.

    Grouping keeps only a minimum per node (combined before the shuffle); neighbours are never gathered in a list."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    return moved.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b): component is its smallest reachable id.

    Self-loops and repeated edges are harmless; nodes without another node don't appear; an empty edge list
    gives an empty table. Each round is written to the shared folder, so a lost executor repeats one round."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = before = None
    for _ in range(max_rounds):
        # done when a round changes no edge: sums are looked at first, and edges themselves if those agree
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).head()
        if now[0] == 0 or now == digest and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            break
        digest, before = now, edges
        edges = written(_star(_star(edges, True), False), "stars")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
