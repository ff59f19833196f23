"""Connected components of an edge table, by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(v, c)``: every end of an edge ``(u, v)`` of longs, with the smallest vertex of its component.

    Each round is a join and an aggregate on different keys, written to the shared folder; rounds end when no label
    changes.  Loops and repeated edges are harmless; nulls must not occur; no edges give no rows.
    """
    e = edges.where("u <> v")
    both = materialise(e.select("u", "v").union(e.select("v", "u")).distinct(), "cc-edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("c")), "cc-labels")
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "v"), "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        step = materialise(step, "cc-step")
        jump = step.join(step.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c")
        new = materialise(jump.select("v", F.least("c", "cc").alias("c"), "old"), "cc-labels")
        labels = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return labels
