"""Connected components of a large graph: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as stars: (smallest of its component, other member)."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node links its larger (or smaller) neighbours to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where("b < a")
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    if larger:
        out = both.where("b > a").join(low, F.col("a") == F.col("n")).select("m", "b")
    else:
        out = both.join(low, F.col("a") == F.col("n")).select("m", "b").unionByName(low.select("m", F.col("n").alias("b")))
    return out.where("m <> b").distinct().select(F.col("m").alias("a"), F.col("b").alias("b"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges (a, b, both long); root is the smallest node.

    A node's neighbours are never gathered: rounds only take minima, which aggregate
    before the shuffle, and joins, which AQE splits where a hub is hot. Rounds grow with
    the logarithm of the largest component; each is written to the shared folder.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = stage(_star(_star(edges, True), False), "cc-round")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
