"""Connected components of a graph held as rows, by contraction; nothing of it is collected.

In each round every node points to the smallest of its neighbours and itself, then to where that one points, and the
links are redrawn between the nodes pointed to; links inside what became one node vanish.  A path halves at least, so
the rounds grow with the logarithm of a component's breadth, and the links that are left shrink from round to round.
Rounds are written to the shared folder.  Minima combine before their shuffle, so a node with very many links is one
row per task there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, released


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable by links) of every node that has a link.  Links may repeat.

    The rounds' tables are deleted once the answer is written.
    """
    with released() as keep:
        edges = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")
        rounds: list[DataFrame] = []
        while edges.limit(1).count():
            ends = edges.select("a", F.col("a").alias("m")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("m")))
            points = ends.groupBy("a").agg(F.min("m").alias("m"))
            beyond = points.select(F.col("a").alias("m"), F.col("m").alias("p"))
            jumped = materialize(points.join(beyond, "m").select(F.col("a").alias("node"), "p"), "labels")
            rounds.append(jumped)
            of = lambda name: jumped.select(F.col("node").alias(name), F.col("p").alias(f"p{name}"))
            drawn = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            edges = materialize(drawn.where("a < b").distinct(), "links")
        if not rounds:
            return keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
        follow = lambda so_far, step: so_far.join(step.select(F.col("node").alias("p"), F.col("p").alias("q")), "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        return keep(reduce(follow, rounds).withColumnRenamed("p", "component"), "labels")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of ``n`` nodes: the smallest of its component under the links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root
