"""Connected components of links, without gathering them anywhere.

Each round points every node at the smallest label among itself and its neighbours and then follows
labels to their labels (pointer jumping). A round is an aggregation with map-side minima and
skew-splittable joins, and ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekledger.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``uid, comp``: the smallest node each linked node can reach."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    edges = written(both.filter("x != y").distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("uid")).agg(F.least(F.min("y"), F.col("x")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("uid", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("x", "uid"), "uid").select(
            "uid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        lower = written(lower, "labels")
        # a label is itself a node: its own label is at most as large
        jump = lower.select(F.col("uid").alias("comp"), F.col("comp").alias("next"))
        labels = written(
            lower.join(jump, "comp", "left").select("uid", "old", F.least("comp", "next").alias("comp")), "labels"
        )
        if labels.filter("comp != old").isEmpty():
            return labels.select("uid", "comp")
        labels = labels.select("uid", "comp")
