"""Connected components of a graph of links, without bringing it to one task or to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


class Forest:
    """Union-find on 0..n-1 that takes links in arrays and keeps those that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if not apart.any():
            return
        n = len(self.root)
        pair, first = np.unique(np.minimum(ra, rb)[apart] * n + np.maximum(ra, rb)[apart], return_index=True)
        for p, x, y in zip(pair, a[apart][first], b[apart][first], strict=True):
            u, v = self.find(int(p // n)), self.find(int(p % n))
            if u != v:
                self.root[max(u, v)] = min(u, v)
                self.links.append((int(x), int(y)))
        while not np.array_equal(flat := self.root[self.root], self.root):
            self.root = flat


def _unfinished(e: DataFrame) -> bool:
    """Has a node two links upwards, or one upwards and one downwards?"""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    n = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return n.where("up > 1 or (up > 0 and down > 0)").limit(1).count() > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node that has a link to another, the smallest node that it reaches.

    Alternates large-star and small-star steps (each a minimum by key, which is pre-aggregated, and a join that
    adaptive execution splits where a key is hot), so that every component becomes a star around its smallest node. The
    steps take about the logarithm of the longest path; they end when every node has one link upwards or is a centre,
    which one count by node tells. Links to itself or with a null end are passed over.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v and u is not null and v is not null").distinct()
    e = cut(e)
    while _unfinished(e):
        # large star: link all larger neighbours of a node to its smallest neighbour (itself included)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: link all smaller neighbours of a node, and itself, to the smallest
        large = cut(large.where("u != v").distinct())
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
