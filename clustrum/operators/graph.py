"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.scratch import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id, component: the smallest row_id that each of nodes (row_id) reaches over undirected edges (u, v).

    Each round lowers labels to the least neighbouring one, then follows labels once (pointer jumping), so long chains
    shrink by halves. Every round is written to the shared folder, so plans stay short and lost executors cost little.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    label = cut(nodes.select("row_id", F.col("row_id").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("row_id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        low = label.join(near.withColumnRenamed("u", "row_id"), "row_id", "left").select("row_id", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = low.join(low.select(F.col("row_id").alias("low"), F.col("low").alias("next")), "low").select("row_id", F.least("low", "next").alias("component"))
        after = cut(jump, "labels")
        changed = after.join(label.withColumnRenamed("component", "was"), "row_id").where("component <> was").limit(1).count()
        label = after
        if not changed:
            return label
