"""Exact top-k over vectors of one component, which have one list only."""

from pyspark.sql import functions as F

from passbook.llm import topk


def test_negative_scores_of_one_component(spark):
    rows = spark.createDataFrame([(0, [100.0])] + [(i, [-float(i)]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    found = topk.top(rows, F.col("vec_id") == 0, 5, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, -100 * i) for i in range(1, 6)]
