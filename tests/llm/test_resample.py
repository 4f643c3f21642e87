"""Importance resampling next to SQL and a plain version; the radix sort on hard keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import compare
from passbook.llm import queries, radix, resample


def test_resample_equals_sql(spark, sf_dir):
    assert compare.difference(spark, compare.connect(sf_dir), sf_dir, "op11_importance_resampling") == ""


def plain(docs, target, runs, buckets, seed, percent, least):
    def words(text):
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)

    def cells(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(c for _, text in rows for c in cells(text)) for rows in (docs, target))
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)
    ]
    out = []
    for doc_id, text in docs:
        c = cells(text)
        weight = sum(gain[b] for b in c) // len(c) if c else 0
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(c), weight, score, None, len(words(text))])
    entered = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(entered[: percent * len(entered) // 100]):
        r[4] = i + 1
    return sorted(tuple(r[:5]) for r in out)


def test_resample_runs_of_words_and_any_bytes(spark):
    draw = random.Random(1)
    word = ["Straße", "naïve", "a1", "B2", "日本", "x", "y" * 300, "end."]
    rows = [(i, draw.choice([" ", "-", "\n\t"]).join(draw.choices(word, k=draw.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "?! .")]
    target = [(0, "naïve a1 b2"), (1, None)]
    frames = [spark.createDataFrame(x, "doc_id long, text string") for x in (rows, target)]
    got = resample.resample(*frames, runs=2, buckets=50, seed=7, percent=40, least_words=5).collect()
    want = plain(rows, target, 2, 50, 7, 40, 5)
    assert sorted(tuple(r) for r in got) == want


def test_resample_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text, 1, 1), (1, text, 1, 1), (1, text, 1, 1), (1, text + " more", 1, 1), (2, None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos long, score long")
    target = docs.select("text", "pos")
    got = resample.resample(docs, target, percent=100).collect()
    assert sorted(r.rank for r in got if r.doc_id == 1) == [1, 2, 3]
    assert [(r.score, r.rank) for r in got if r.doc_id is None] == [(None, None)]
    assert [(r.n_features, r.weight, r.rank) for r in got if r.doc_id == 2] == [(0, 0, None)]
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs, target.limit(0)).count() == 5


@pytest.mark.parametrize("block_bits", [3, 12])
def test_positions(spark, monkeypatch, block_bits):
    """Equal keys, keys below zero, keys at both ends of 64 bits."""
    monkeypatch.setattr(radix, "BLOCK_BITS", block_bits)
    draw = random.Random(block_bits)
    rows = [(draw.choice([-5, 0, 7, 10**9]), draw.randint(-(2**63), 2**63 - 1)) for _ in range(300)] + [(7, 5)] * 100
    frame = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = radix.positions(frame, [("a", True), ("b", False)]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(400))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    same = radix.positions(frame.withColumn("a", F.lit(1).cast("long")), [("a", False)])
    assert sorted(r.pos for r in same.collect()) == list(range(400))
    assert radix.positions(frame.limit(0), [("a", False)]).count() == 0
