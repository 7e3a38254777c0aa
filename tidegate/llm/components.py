"""Connected components of a link table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path. Labels are summed up before
    the shuffle, and hot nodes only ever meet in joins that Spark can split; every round is written
    to the shared folder, which cuts the lineage.
    """
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("component"), F.col("a").alias("before")
        ),
        "labels",
    )
    while not labels.where("component <> before").isEmpty():
        at = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = written(
            step.join(jump, "component", "left").select(
                "node", F.least("component", F.coalesce("far", "component")).alias("component"), "before"
            ),
            "labels",
        )
    return labels.select("node", "component")
