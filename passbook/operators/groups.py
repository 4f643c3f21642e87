"""Connected groups of an edge table, with a stored table between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.session import saved, shared_dir


def connected(edges: DataFrame) -> DataFrame:
    """(node, group) for each node of ``edges`` (a, b): the smallest node that it can reach.

    Each round hooks the group of a node to the smallest group next to it, then follows the
    hooks once more, so groups grow at least twofold and rounds with the logarithm of the
    longest path. Edges inside a group leave the table, which shrinks as groups grow.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, "groups")
    first = edges.select(F.inline(F.array(F.struct("a"), F.struct(F.col("b").alias("a")))))
    labels = saved(
        first.select(F.col("a").alias("node")).distinct().withColumn("group", F.col("node")), f"{folder}/labels"
    )
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), f"{folder}/edges")
    step = 0
    while not edges.isEmpty():
        # Every group points to the smallest one among itself and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        step += 1
        hook = saved(hook, f"{folder}/hook-{step}")
        while True:
            onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            followed = hook.join(onward, "to").select("a", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved"))
            step += 1
            hook = saved(followed, f"{folder}/hook-{step}")
            if hook.where("moved").isEmpty():
                break
        to = hook.select("a", "to")
        labels = saved(
            labels.join(to.withColumnRenamed("a", "group"), "group", "left").select(
                "node", F.coalesce("to", "group").alias("group")
            ),
            f"{folder}/labels-{step}",
        )
        of_a, of_b = to.withColumnRenamed("to", "ta"), to.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = saved(
            edges.join(of_a, "a").join(of_b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(),
            f"{folder}/edges-{step}",
        )
    return labels
