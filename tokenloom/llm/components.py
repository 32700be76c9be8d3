"""Connected components of an edge table, as Spark joins and aggregates (alternating star contraction).

Each round points every node at the least node in its neighbourhood: first towards smaller neighbours of the
whole neighbourhood, then within the smaller neighbours. Minima are combined map-side, hubs are split by
adaptive skew joins, and each round's edges are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import discard, materialise


def _signature(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the edges a-b (longs); component is the least id reachable. Self-loops and nulls count as no edge; rounds is a guard far above the logarithmic number needed."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        mark = _signature(now)
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = mark
        last, now = now, materialise(_small_star(_large_star(now)))
        discard(last)
    raise RuntimeError("components did not settle")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each of n nodes' component under the edges a-b: hooking and pointer jumping on arrays."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
