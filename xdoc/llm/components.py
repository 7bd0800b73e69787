"""Connected components by spreading the least label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs in; each of their vertices with the least vertex of its component out (v, label).

    Every round takes each vertex to the least label around it and then to that label's own label,
    so the number of rounds grows with the logarithm of a component's width on usual graphs. Labels
    are written to shared storage each round; nothing is collected.
    """
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["v"]).groupBy(both["a"].alias("v")).agg(F.min("label").alias("least"))
        near = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialize(near.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("v", "label")
        if new.where("old <> label").isEmpty():
            return labels
