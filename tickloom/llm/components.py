"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (columns a, b).

    Every round a node takes the smallest label around it, then the label of
    its label, so long chains shorten by half.  Each round is written, so a
    lost executor costs one round.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("component", "near").alias("next"), F.col("component").alias("before")
        )
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = written(nearer.join(jump, "next").select("node", "before", F.least("next", "far").alias("component")))
        labels = new.select("node", "component")
        if new.filter("component < before").isEmpty():
            return labels
