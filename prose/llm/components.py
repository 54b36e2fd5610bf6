"""Connected components of a graph of long ids, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(id, label): of every id in edges (a, b), the least id of its component.

    Every round takes the least label among neighbours, then that of the label itself, so rounds
    grow with the logarithm of a component's width. Minima are pre-aggregated; no node's
    neighbours are ever collected. Each round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    held = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("new")))
    while True:
        labels = held.select("id", F.col("new").alias("label"))
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = cut(labels.join(near, "id").select("id", "label", F.least("label", "m").alias("m")))
        discard(held)
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("far"))
        held = cut(step.join(jump, "m").select("id", "label", F.least("m", "far").alias("new")))
        discard(step)
        if held.filter("label != new").isEmpty():
            discard(both)
            return held.select("id", F.col("new").alias("label"))
