"""Connected components of an undirected edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm.batches import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; nodes of one component share a root.

    Each round maps every node to the smallest of itself and its neighbours, follows that
    map once more, replaces the ends of all edges by what they map to and drops edges that
    became loops; the round count grows with the logarithm of the longest chain.  Each round's
    edges and map are written to the shared folder, so nothing is recomputed after a loss.
    Minima combine map-side before the shuffle, so a hub costs one row per task.  NULL ends
    and loops are no edges; repeated edges count once; an empty table gives no rows.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).withColumn("low", F.least("node", "low"))
        near = staged(near, "near")
        hop = near.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        step = staged(near.join(hop, "low").select("node", F.col("lower").alias("to")), "step")
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            roots = roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b").where("to_a <> to_b")
        edges = staged(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if roots is None:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").cast(kind).alias("node"), F.col("a").cast(kind).alias("root"))
    return roots
