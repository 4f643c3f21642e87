"""What the vector searches share: distinct vectors with their first ids, and result lists.

Searches run over classes of equal vectors, so copies of a vector, however many, are compared
once. A class keeps only as many of its smallest ids as a result can hold, one more for the
query itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.session import saved, shared_dir


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    limit = F.lit(float("inf"))
    return F.coalesce(
        vector.isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)),
        F.lit(False),
    )


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (vec_id, v), v an array, as a stored table (cid, v, ids): the ``k`` + 1
    smallest ids of each distinct vector. Null ids and repeated rows are left out."""
    spark = rows.sparkSession
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    firsts = (
        rows.where(F.col("vec_id").isNotNull())
        .distinct()
        .withColumn("n", F.row_number().over(by_vector))
        .where(F.col("n") <= k + 1)
    )
    found = firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return saved(found.select(F.xxhash64("v", F.col("ids")[0]).alias("cid"), "v", "ids"), shared_dir(spark, "vectors"))


def queries_of(rows: DataFrame, known: DataFrame, chosen: Column) -> DataFrame:
    """Stored (vec_id, cid) for the rows that are queries."""
    spark = rows.sparkSession
    asked = rows.where(chosen).distinct()
    return saved(asked.join(known.select("v", "cid"), "v").select("vec_id", "cid"), shared_dir(spark, "queries"))


def best(table: pa.Table, k: int, score: str = "score") -> pa.Table:
    """Of one query's lists (qid, cids, firsts, score lists) the ``k`` best classes, each once:
    highest score first, then smallest first id."""
    cid = np.asarray(table["cids"].combine_chunks().flatten())
    first = np.asarray(table["firsts"].combine_chunks().flatten())
    value = np.asarray(table[score].combine_chunks().flatten())
    order = np.lexsort((first, -value))
    _, one = np.unique(cid[order], return_index=True)
    pick = order[np.sort(one)[:k]]
    n = len(pick)
    qid = table["qid"][0].as_py()
    return pa.table(
        {
            "qid": pa.array([qid] * n, pa.int64()),
            "cid": pa.array(cid[pick]),
            "first": pa.array(first[pick]),
            "score": pa.array(value[pick]),
        }
    )


def ranked(scored: DataFrame, known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``scored`` (qid, cid, score) with ``k`` + 1 classes
    a query class, ids of ``known`` and the queries ``asked`` (vec_id, cid)."""
    ids = known.select("cid", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    lists = (
        scored.join(ids, "cid")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    )
    lists = saved(lists, shared_dir(scored.sparkSession, "found"))
    of_query = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).join(lists, "qid")
    others = F.filter("found", lambda x: x.vec_id != F.col("query_id"))
    return of_query.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score"
    )
