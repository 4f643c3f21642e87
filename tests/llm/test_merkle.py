"""The Merkle manifest next to SQL and to a plain version with several rounds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import compare
from passbook.llm import merkle


def test_merkle_equals_sql(spark, sf_dir):
    assert compare.difference(spark, compare.connect(sf_dir), sf_dir, "op13_merkle_manifest") == ""


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for each leaf, its siblings level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i - i % 8
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            steps = path + above
            proof = digest("".join(a + b for a, b in steps))
            out.append((row[0], plain_leaf(row), trees[g][0], root, proof, root, True))
    return out


@pytest.mark.parametrize("local, counts", [(1, (70, 64, 9, 1)), (1, (585, 8, 65)), (3, (513, 512, 3))])
def test_merkle_of_ragged_groups(spark, monkeypatch, local, counts):
    """Groups of all shapes: full, one more than full, single, null; several butterfly rounds."""
    monkeypatch.setattr(merkle, "LOCAL", local)
    names = [None, "en", "dé", "zh"]
    draw = random.Random(sum(counts))
    rows = [(k * 1000 + i, "s", names[k], i if i % 3 else None, "t" * draw.randint(0, 5)) for k, n in enumerate(counts) for i in range(n)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {})
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))


def test_merkle_with_a_name_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LOCAL", 1)
    rows = [(i, None, f"lang{i}", 1, "A") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.prove(docs).collect()
    assert sorted(r[:5] for r in map(tuple, got)) == sorted(r[:5] for r in plain(rows))


def test_merkle_edges(spark):
    rows = [(None, None, None, None, None, 1), (1, "a", "en", 2, "Ab", 1), (1, "a", "en", 2, "Ab", 1), (2, "", "", 0, "", 1)]
    rows += [(3, "a", "en", 9, "Ab " * 50_000, 1)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf long"
    docs = spark.createDataFrame(rows, schema)
    got = merkle.prove(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    want = plain([r[:5] for r in rows])
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted((str(w[0]), *w[1:5]) for w in want)
    assert next(r for r in got if r.doc_id is None).leaf == digest("-----")
    assert merkle.prove(docs.limit(0)).count() == 0
    # A changed row fails, an unchanged one holds; a lone row is its own root, without siblings.
    lone = docs.where("doc_id = 2")
    assert [(r.leaf == r.root, r.proof_sha256) for r in merkle.prove(lone).collect()] == [(True, digest(""))]
    changed = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "text"], {"text": F.lower("text")}).collect()
    assert {(r.doc_id, r.verified) for r in changed} == {(None, True), (1, False), (2, True), (3, False)}
    assert all((r.folded_root == r.root) == r.verified for r in changed)
