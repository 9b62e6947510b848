"""Connected components of an undirected graph as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.session import checkpoint_dir


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star step.  Every node points its neighbours (the larger ones, or in the small
    step the smaller ones and itself) at the least node around it.  The least node is a
    partial aggregate and the join on a node of many edges is one that Spark splits."""
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), either way round -> (node, component) for every node with an edge to
    another one; the component is its least node.  Alternating large and small stars;
    rounds grow with the logarithm of a component's size.  Lineage is cut after each
    round by a checkpoint in the shared folder; the driver sees one sum a round."""
    checkpoint_dir(edges.sparkSession)
    now = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    before = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        now = _starred(_starred(now, small=False), small=True).checkpoint()
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
