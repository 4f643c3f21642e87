"""Nearest vectors where lengths differ and where there are few, next to all scores."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.llm import ann, neighbours, queries, topk
from passbook.session import saved


def found_by(spark, ids, v, step):
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % step == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    return found


def wanted(ids, v, i, k=20):
    score = v @ v[i]
    return [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:k]


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    data = sorted(queries.table(spark, sf_dir, "embeddings").collect(), key=lambda r: r.vec_id)
    return np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)


@pytest.mark.parametrize("n", [10, 21, 50])
def test_few_vectors_are_all_compared(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(n)
    found = found_by(spark, ids, v, 1)
    for i in ids.tolist():
        assert found[i] == wanted(ids, v, i)


def test_a_rare_dimension_is_all_compared(spark, given):
    ids, v = given
    few = np.random.default_rng(5).normal(size=(30, 48))
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(10_000 + i, x.tolist()) for i, x in enumerate(few)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") >= 10_000).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    for i in range(30):
        assert found[10_000 + i] == wanted(10_000 + np.arange(30), few, i)


def recall(spark, ids, v):
    found = found_by(spark, ids, v, 20)
    at = np.flatnonzero(ids % 20 == 0)
    assert all(len(found[ids[i]]) == 20 for i in at)
    return np.mean([len(set(found[ids[i]]) & set(wanted(ids, v, i))) / 20 for i in at])


@pytest.mark.parametrize("times", [3.0, 100.0])
def test_one_outlier(spark, given, times):
    ids, v = given
    v = v.copy()
    v[7] *= times
    assert recall(spark, ids, v) >= 0.9


def test_spread_lengths(spark, given):
    ids, v = given
    assert recall(spark, ids, v * np.exp(np.random.default_rng(3).normal(scale=0.3, size=(len(v), 1)))) >= 0.9


def test_queries_of_a_hot_cell_are_dealt(spark, monkeypatch):
    """Vectors around one direction fall into one cell, and all queries visit it."""
    stored = {}

    def keep(frame, path, *args, **kwargs):
        stored[path.rsplit("/", 1)[-1].split("-")[1]] = out = saved(frame, path, *args, **kwargs)
        return out

    monkeypatch.setattr(ann, "saved", keep)
    monkeypatch.setattr(ann, "QUERY_ROWS", 100)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 300)
    draw = np.random.default_rng(11)
    v = draw.normal(size=64) + 0.05 * draw.normal(size=(1500, 64))
    ids = np.arange(1500)
    found = found_by(spark, ids, v, 2)
    right = [len(set(found[i]) & set(wanted(ids, v, i))) / 20 for i in range(0, 1500, 50)]
    assert np.mean(right) >= 0.9
    asked = stored["probes"].select("dim", "band", "tab", F.explode("cells").alias("cell")).groupBy("dim", "band", "tab", "cell").count()
    dealt = stored["dealt"].join(asked, ["dim", "band", "tab", "cell"]).collect()
    assert max(r["count"] for r in dealt) > 500
    assert all(r["count"] <= 100 * r.parts for r in dealt)


def test_exact_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 300)
    v = np.random.default_rng(12).integers(-40, 40, size=(900, 6))
    ids = np.arange(900)
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v.astype(float), strict=True)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in topk.top(rows, F.col("vec_id") % 2 == 0, 7, scale=1).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert len(found) == 450
    for i in range(0, 900, 2):
        assert found[i] == [(j, int(v[j] @ v[i])) for j in wanted(ids, v, i, 7)]


def test_exact_search_broadcasts_no_vectors(spark, monkeypatch):
    """The driver builds what is broadcast, and queries times blocks, or vectors that are small as stored, outgrow it."""
    frames = []

    def keep(frame, *args, **kwargs):
        frames.append(frame)
        return saved(frame, *args, **kwargs)

    monkeypatch.setattr(topk, "saved", keep)
    monkeypatch.setattr(neighbours, "saved", keep)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    v = np.random.default_rng(13).integers(-40, 40, size=(900, 6)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    frames.append(topk.top(rows, F.col("vec_id") % 20 == 0, 7, scale=1))
    assert frames[-1].count() == 45 * 7
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = "\n".join(frame._jdf.queryExecution().explainString(mode) for frame in frames)
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: (.*)", text)
    assert sent and not [x for x in sent if re.search(r"\b(v|q)#", x)]
