"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge; component is the smallest node reachable.

    ``edges`` has long columns a and b. Alternating large-star and small-star steps: in each, a node
    is linked to the smallest of its neighbours, until the edges form stars. Every step is groupBy
    and join, and is written out, so a lost executor costs one step. Nulls and loops are ignored;
    repeated edges count once; an empty table gives an empty result.
    """
    edges = written(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = written(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def forest(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Labels of 0..n-1 after joining each left with its right: min-label hooking and shortcuts, in numpy."""
    label = np.arange(n) if parent is None else parent
    while left.size:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
