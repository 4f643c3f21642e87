"""A projection of topic partitions whose rows come in any order.

Rows carry the offset that the publisher numbered them with. Of each topic partition the
frontier is the lowest offset below which everything has arrived: rows below it were applied
and are dropped when they come again, rows from it on are applied as far as they close up,
and rows beyond a missing one are held until it comes. So nothing is lost, whatever files
tasks wrote and batches read first, and nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from passbook.functions.money import signed_money
from passbook.schema import CATCH_UP, PROJECTED_KINDS
from passbook.session import saved, shared_dir
from passbook.streaming.batches import BatchTable
from passbook.streaming.projections import run_projection

#: First offset of a topic partition.
FIRST = 1
#: Offsets of a cell; no task orders more rows of a topic partition than that.
WIDTH = 1 << 16
#: Rows of a batch: what it adds to an account, a frontier, a row that is held.
ADDED, FRONTIER, HELD = range(3)

ROWS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("tag", T.IntegerType()),
            ("topic", T.StringType()),
            ("offset", T.LongType()),
            ("seq", T.LongType()),
            ("id", T.StringType()),
            ("kind", T.StringType()),
            ("money", T.LongType()),
            ("owner", T.StringType()),
            ("events", T.LongType()),
        )
    ]
)


def frontiers(rows: DataFrame, known: DataFrame, width: int = WIDTH) -> DataFrame:
    """(topic, next): the first offset of each topic that neither ``rows`` (topic, offset, each
    once, none below the known frontier) nor what came before has. ``known``: topic, next.

    Each cell of offsets is counted off by itself; then a row per cell tells how far a topic's
    cells close up.
    """
    cell = F.expr(f"`offset` div {width}")
    placed = rows.select("topic", "offset", cell.alias("cell")).join(F.broadcast(known), "topic", "left")
    start = F.greatest(F.coalesce("next", F.lit(FIRST)), F.col("cell") * width)
    by_cell = Window.partitionBy("topic", "cell").orderBy("offset")
    counted = placed.withColumn("start", start).withColumn("n", F.row_number().over(by_cell))
    cells = counted.groupBy("topic", "cell", "start").agg(
        F.count_if(F.col("offset") == F.col("start") + F.col("n") - 1).alias("closed"),
        F.first("next").alias("next"),
    )
    by_topic = Window.partitionBy("topic").orderBy("cell")
    first = F.expr(f"coalesce(next, {FIRST}) div {width}")
    full = F.col("start") + F.col("closed") == (F.col("cell") + 1) * width
    earlier = F.coalesce(F.bool_and(full).over(by_topic.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    reached = earlier & (F.col("cell") == first + F.row_number().over(by_topic) - 1)
    ends = cells.select("topic", F.when(reached, F.col("start") + F.col("closed")).alias("next"))
    return ends.unionByName(known).groupBy("topic").agg(F.coalesce(F.max("next"), F.lit(FIRST).cast("long")).alias("next"))


def frontier_projection(
    stream: DataFrame,
    folder: str,
    name: str = "frontier",
    every: str | None = None,
    checkpoint: str | None = None,
    width: int = WIDTH,
) -> StreamingQuery:
    """Sum up a topic's events per account; ``stream`` is the log with topic and offset.

    A batch writes what it adds to each account, the frontiers and the rows it holds, in one
    write; the next batch reads these of it only. What is held grows with what is missing.
    """
    spark = stream.sparkSession
    table = BatchTable(spark, f"{folder}/{name}", ROWS, _merged).create()

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = table.previous(batch_id)
        marks = before.where(F.col("tag") == FRONTIER)
        known = marks.select("topic", F.col("offset").alias("next"))
        columns = ["topic", "offset", "seq", "id", "kind", "money", "owner"]
        came = batch.withColumnRenamed("aggregate_id", "id").select(*columns)
        rows = came.unionByName(before.where(F.col("tag") == HELD).select(*columns))
        due = rows.join(F.broadcast(known), "topic", "left")  # a row for each topic partition
        due = due.where(F.col("next").isNull() | (F.col("offset") >= F.col("next"))).drop("next")
        due = saved(due.dropDuplicates(["topic", "offset"]), shared_dir(spark, "frontier"))
        reached = saved(frontiers(due, known, width), shared_dir(spark, "frontier"))
        placed = due.join(F.broadcast(reached), "topic")
        ready = placed.where(F.col("offset") < F.col("next"))
        changes = (
            ready.where(F.col("kind").isin(*PROJECTED_KINDS))
            .groupBy("topic", "id")
            .agg(
                F.lit(ADDED).alias("tag"),
                F.count("*").alias("events"),
                F.max("seq").alias("seq"),
                F.sum(signed_money()).alias("money"),
                F.max(F.when(F.col("kind") == "AccountCreated", F.col("owner"))).alias("owner"),
            )
        )
        applied = changes.select("topic", "seq").unionByName(marks.select("topic", "seq"))
        last = applied.groupBy("topic").agg(F.max("seq").alias("seq"))
        token = reached.join(last, "topic", "left").select(
            F.lit(FRONTIER).alias("tag"), "topic", F.col("next").alias("offset"), "seq"
        )
        held = placed.where(F.col("offset") >= F.col("next")).select(F.lit(HELD).alias("tag"), *columns)
        out = changes.unionByName(token, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
        table.write(out, batch_id)

    return run_projection(stream, checkpoint or name, lambda df: df, apply, folder, every=every)


def _merged(rows: DataFrame) -> DataFrame:
    """What many batches added to an account as one row. Frontiers and held rows count in the
    batch that follows only, which reads them from the batch itself."""
    added = rows.where(F.col("tag") == ADDED).groupBy("tag", "topic", "id").agg(
        F.sum("events").alias("events"), F.max("seq").alias("seq"), F.sum("money").alias("money"), F.max("owner").alias("owner")
    )
    last = rows.where(F.col("tag") == FRONTIER).groupBy("tag", "topic").agg(
        F.max("offset").alias("offset"), F.max("seq").alias("seq")
    )
    empty = rows.limit(0).drop("batch_id")
    return empty.unionByName(added, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)


def read_frontier(spark: SparkSession, folder: str, name: str = "frontier") -> DataFrame:
    """Documents (id, version, sequence, balance, owner) summed up from what batches added."""
    rows = BatchTable(spark, f"{folder}/{name}", ROWS).read().where(F.col("tag") == ADDED)
    return (
        rows.groupBy("id")
        .agg(
            F.sum("events").alias("version"),
            F.max("seq").alias("sequence"),
            F.sum("money").alias("balance"),
            F.max("owner").alias("owner"),
        )
        .where("owner IS NOT NULL")
    )


def read_tokens(spark: SparkSession, folder: str, name: str = "frontier", projection: str = "balance") -> DataFrame:
    """Resume tokens (id, token) and the frontier of each topic partition."""
    rows = BatchTable(spark, f"{folder}/{name}", ROWS).read().where(F.col("tag") == FRONTIER)
    last = rows.groupBy("topic").agg(F.max("seq").alias("seq"), F.max("offset").alias("frontier"))
    return last.select(
        F.concat(F.col("topic"), F.lit(f"/{projection}")).alias("id"),
        F.concat(F.lit(f"{CATCH_UP}:"), F.col("seq").cast("string")).alias("token"),
        "frontier",
    )
