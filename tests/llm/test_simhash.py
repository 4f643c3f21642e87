"""SimHash next to a plain version, and the index on codes near and far."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from passbook.llm import components, queries, simhash


def plain_code(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(code, most=2):
    ids = sorted(code)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (code[i] ^ code[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash_equals_plain(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").collect()
    code = {r.doc_id: plain_code(r.text) for r in rows}
    want = plain_components(code)
    got = queries.op12_simhash_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{code[i]:016x}", want[i]) for i in code}
    assert len(got) == len(rows) > len(set(want.values()))


def clusters(seed, n=40, each=12):
    draw = random.Random(seed)
    out = set()
    for _ in range(n):
        centre = draw.getrandbits(64)
        for _ in range(each):
            out.add(centre)
            centre ^= 1 << draw.randrange(64)
            if draw.random() < 0.4:
                centre ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
    return sorted(out | {0, 1, 2**64 - 1, 2**63})


def test_index_joins_all_that_is_near(spark, monkeypatch):
    """Small blocks, so that the join goes through several levels of nodes."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "FANOUT_BITS", 1)
    monkeypatch.setattr(simhash, "AT_ONCE", 8)
    code = dict(enumerate(clusters(3)))
    frame = spark.createDataFrame(
        [(int(np.uint64(c).view(np.int64)), i) for i, c in code.items()], "code long, node long"
    )
    blocks = simhash.blocks_of(frame)
    assert blocks.count() > 60
    links = simhash.block_links(simhash.near_blocks(blocks, 2), blocks, 2)
    got = {r.node: r.component for r in components.components(links).collect()}
    want = plain_components(code)
    assert {i: got.get(i, i) for i in code} == want
    assert links.count() < 3 * len(code)


def test_tasks_find_each_near_pair_once(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    x = np.array(clusters(5, 6, 15), np.uint64)
    y = np.array(clusters(6, 3, 3)[:1] + clusters(5, 6, 15)[::3], np.uint64)
    for a, b, same in ((x, x, True), (x, y, False), (y, x, False), (x[:1], x[:1], True), (x[:1], x[5:6], False)):
        got = sorted((int(i), int(j)) for p, q in simhash.near_codes(a, b, 2, same) for i, j in zip(p, q, strict=True))
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
        assert got == [(i, j) for i, j in np.argwhere(near).tolist() if not same or i < j]


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(50_000))
    rows = [
        (1, None, 0, 0),
        (2, "", 0, 0),
        (3, " \t\n", 0, 0),
        (4, "one two", 0, 0),
        (5, "ONE\ntwo", 0, 0),
        (6, long, 0, 0),
        (7, long, 0, 0),
        (7, "one two", 0, 0),
        (None, long, 0, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code long, component_id long")
    got = simhash.cluster(docs).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4), (None, None)}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.cluster(docs.limit(0)).count() == 0
    assert simhash.cluster(docs.where(F.col("doc_id") == 1)).count() == 1
