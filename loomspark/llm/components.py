"""Connected components by alternating large and small stars, as joins and aggregates.

Every round turns each node's edges into edges to the smallest node it knows, until all
components are stars. No round collects a node's neighbours anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rounds grow with the logarithm of the longest path; more than so many would mean an error.
ROUNDS = 200


def components(ws: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node of its component) of every node in edges (columns u and v)."""
    current = ws.save(edges.select("u", "v").where("u != v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}0")
    before = None
    for i in range(1, ROUNDS):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(smallest, "u")
        small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).distinct()
        ws.drop(f"{name}{i - 2}") if i > 1 else None
        current = ws.save(small, f"{name}{i}")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't stable after {ROUNDS} rounds")
    del both, smallest, large, linked, small  # their plans are held in the driver as long as these names are
    ws.release()
    stars = current.groupBy("u").agg(F.min("v").alias("label"))
    return stars.select(F.col("u").alias("node"), "label").union(stars.select(F.col("label").alias("node"), "label").distinct())
