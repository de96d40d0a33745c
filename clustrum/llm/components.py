"""Connected components of an edge table, without gathering an unbounded group anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

#: Edges up to which one task joins them by union-find (about 200 MB); more edges go through star rounds.
ONE_TASK_EDGES = 2_000_000

_PAIRS = "node long, component long"


def _union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node that each node of (u, v) reaches; nulls and loops are left out.

    Small edge sets go to one task. Larger ones take large-star and small-star rounds (Kiveris et al. 2014): every
    round sends a row for each edge, keyed by node, beside minima that are aggregated before the shuffle, so a hub is
    split like any other skewed join key. The loop ends when a round changes nothing.
    """
    edges = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= one_task_edges:
        return edges.coalesce(1).mapInPandas(_union_find, _PAIRS)

    def minima(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "minima")

    def total(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = total(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        large = both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = minima(down)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        after = cut(small.where("u <> v").distinct(), "edges")
        drop(edges)
        edges, seen, state = after, state, total(after)
        if state == seen:
            break
    tops = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return tops.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(tops.select("node"), "node", "left_anti"))
