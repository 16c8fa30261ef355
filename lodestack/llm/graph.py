"""Connected components by contraction, with aggregations and joins only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges; the root is the least node of its component.

    Each round points every node at its least neighbour, follows the pointers, and contracts the edges to the nodes that
    pointers end at. No step gathers a node's neighbours: they only meet in a minimum, which is taken before the shuffle
    too, so a node with very many edges is no burden to one task. Self-loops and repeated edges are harmless; null ends are
    ignored; without edges the result is empty.
    """
    least, most = F.least(a, b), F.greatest(a, b)
    current = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(least.alias("a"), most.alias("b")).distinct())
    roots: DataFrame | None = None
    old: list[DataFrame] = []  # tables that the next round's no longer need
    for _ in range(rounds):
        ends = current.where(F.col("a") < F.col("b"))
        pointer = ends.select(F.col("b").alias("node"), F.col("a").alias("up")).union(ends.select(F.col("a").alias("node"), F.col("a").alias("up")))
        if roots is None:
            pointer = pointer.union(current.select(F.col("a").alias("node"), F.col("a").alias("up")))
        table = stored(pointer.groupBy("node").agg(F.min("up").alias("up")))
        pointer = table
        for _ in range(rounds):  # pointers go down in value, so following them ends; each step doubles what is followed
            up = pointer.select(F.col("node").alias("up"), F.col("up").alias("top"))
            last, table = table, stored(pointer.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("next"), "up"))
            discard(last)
            moved = table.where(F.col("next") != F.col("up")).limit(1).count()
            pointer = table.select("node", F.col("next").alias("up"))
            if not moved:
                break
        if roots is None:
            roots, base = pointer.select("node", F.col("up").alias("root")), table
            roots._lodestack_path = table._lodestack_path
        else:
            roots = stored(roots.join(pointer.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
            old += [base, table]
            base = roots
        first = pointer.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        second = pointer.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        joined = ends.join(first, "a").join(second, "b").where(F.col("ra") != F.col("rb"))
        old.append(current)
        current = stored(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(*old)
        old = []
        if not current.limit(1).count():
            discard(current)
            return roots
    raise RuntimeError("the components did not settle")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges in memory: every node that isn't the least of its component, and that least node."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]
