"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.session import written


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for every node of ``edges`` (a, b); the label is the smallest key of the component.

    Every round takes the smallest label among the neighbours and then the label of the label, so paths shrink by
    doubling. Each round is written to the shared folder; nodes without edges do not appear.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        labels = written(step.join(jump, "label").select("key", "old", F.least("label", "far").alias("label")), "labels")
        if labels.filter("label != old").isEmpty():
            return labels.select("key", "label")
