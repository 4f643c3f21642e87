"""Connected components of an edge table, with tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.session import saved, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node it can reach.

    Each round gives every node the smallest label among its own and its neighbours', then
    the label of that label. Labels only fall, and a round without a change ends it; labels
    of labels halve the distance, so the rounds grow with the logarithm of the longest path.
    Sums of hot nodes are made before the shuffle, and joins have tables on both sides, which
    lets Spark split them. No edges, no rows; edges that repeat or loop are harmless.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.distinct(), shared_dir(spark, "edges"))
    labels = saved(
        both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("component")
        ),
        shared_dir(spark, "labels"),
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        lowered = saved(lowered, shared_dir(spark, "labels"))
        if lowered.where(F.col("old") != F.col("component")).isEmpty():
            return labels
        of_label = lowered.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = saved(
            lowered.join(of_label, "component").select("node", F.col("next").alias("component")),
            shared_dir(spark, "labels"),
        )
