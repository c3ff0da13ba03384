"""Connected components by least labels, for graphs of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.store import stored


def label_components(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes of ``edges(a, b)`` with the least node of their component.

    Each round takes the least label among neighbours and then that label's own label, so rounds
    grow with the logarithm of a component's length.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(least, "node").select("node", F.least("component", "near").alias("next"), "component")
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        now = stored(jump.select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("changed")))
        if not now.where("changed").limit(1).count():
            return now.select("node", "component")
        labels = now.select("node", "component")
