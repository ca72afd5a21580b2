"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import stored


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each of the nodes 0..n-1 is linked to by the edges (u, v), directly or not."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        if not len(u):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that stands in `edges` (a, b); root is the smallest node reachable.

    Contraction: each round every node points to its smallest neighbour or itself, chains of pointers are
    shortened, and edges are replaced by those between the nodes pointed at. Nodes that are left are at
    least halved in number in each part of the graph, until no edge is left. All tables of a round are
    written to the shared folder, so that a lost executor repeats one step and every join reads tables:
    Spark then splits the keys on which large components meet.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    labels = stored(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("b")).toDF("node", "up"), "up")
        while True:
            over = up.toDF("n2", "up2")
            up = stored(up.join(over, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"), (F.col("up") != F.coalesce("up2", "up")).alias("moved")), "up")
            moved = not up.where("moved").isEmpty()
            up = up.select("node", "up")
            if not moved:
                break
        left, right = up.toDF("na", "ra"), up.toDF("nb", "rb")
        labels = stored(labels.join(left, F.col("root") == F.col("na"), "left").select("node", F.coalesce("ra", "root").alias("root")), "labels")
        half = stored(edges.join(left, F.col("a") == F.col("na")).select(F.col("ra").alias("a"), "b"), "half")
        moved_edges = half.join(right, F.col("b") == F.col("nb")).select("a", F.col("rb").alias("b")).where("a <> b")
        edges = stored(moved_edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
