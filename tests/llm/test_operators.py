"""Each operator next to a plain version of it, on the small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import compare
from passbook.llm import binary, packing, queries


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return sorted(queries.table(spark, sf_dir, "documents").collect(), key=lambda r: r.doc_id)


def words(text):
    return (text or "").encode().split()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_mix_equals_sql(spark, sf_dir):
    assert compare.difference(spark, compare.connect(sf_dir), sf_dir, "op2_mix_sources") == ""


def test_mix_meets_targets_and_repeats(spark, sf_dir, rows):
    first = queries.op2_mix_sources(spark, sf_dir).collect()
    assert Counter(first) == Counter(queries.op2_mix_sources(spark, sf_dir).collect())
    source = {r.doc_id: r.source for r in rows}
    taken, target = Counter(), {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_language_held_out(spark, sf_dir, rows):
    found = {r.doc_id: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    assert set(found) == {r.doc_id for r in rows}
    out = [r for r in rows if held_out(r.doc_id)]
    assert all(found[r.doc_id].held_out == held_out(r.doc_id) for r in rows)
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in out]) > 0.95


def test_quality_held_out(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    found = queries.op6_quality_classifier(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert np.mean([r.predicted == labels[r.doc_id] for r in found if r.held_out and r.doc_id in labels]) > 0.85


def test_packing(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r.doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    found = queries.op5_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.01 * -(-sum(r.length for r in found) // 2048) + 1


def test_plan_places_each_piece_once():
    rng = np.random.default_rng(1)
    histogram = np.zeros(2049, np.int64)
    np.add.at(histogram, rng.integers(1, 2049, 5000), 1)
    plan = packing.plan(histogram)
    used = np.zeros(plan.n_sequences, np.int64)
    n_of = Counter()
    for length, slot, first, offset in sorted(plan.runs, key=lambda r: (r[0], r[1])):
        assert slot == n_of[length]
        later = [s for n, s, _, _ in plan.runs if n == length and s > slot]
        n = (min(later) if later else int(histogram[length])) - slot
        n_of[length] += n
        used[first : first + n] += length
        assert offset + length <= 2048
    assert used.max() <= 2048 and used.sum() == (histogram * np.arange(2049)).sum()
    assert plan.n_sequences <= 1.005 * used.sum() / 2048 + 1


def test_token_files(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.op7_token_files(spark, sf_dir).collect()}
    at = 0
    for r in rows:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        got = found[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_bits_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_000, dtype=np.uint32)
    bounds = np.array([0, 3, 3, 5000, 9999, 10_000])
    block = binary.Block.of(binary.block([7, None, 8, 9, 9], ids, bounds, bits) + b"\n")
    for i in range(5):
        assert (block.ids(i) == ids[bounds[i] : bounds[i + 1]]).all()
    assert block.null.tolist() == [False, True, False, False, False]


def test_substring(spark, sf_dir, rows):
    text = {r.doc_id: words(r.text) for r in rows}
    first = {}
    for r in rows:
        for i in range(len(text[r.doc_id]) - 12):
            first.setdefault(tuple(text[r.doc_id][i : i + 13]), r.doc_id)
    found = {r.doc_id: r for r in queries.op8_substring_dedup(spark, sf_dir).collect()}
    for r in rows:
        own = text[r.doc_id]
        keep = [True] * len(own)
        for i in range(len(own) - 12):
            if first[tuple(own[i : i + 13])] < r.doc_id:
                keep[i : i + 13] = [False] * 13
        kept = b" ".join(w for w, k in zip(own, keep, strict=True) if k)
        got = found[r.doc_id]
        assert (got.n_words, got.n_removed) == (len(own), len(own) - sum(keep))
        assert got.kept_sha256 == hashlib.sha256(kept).hexdigest()


def plain_components(sets, percent):
    """Smallest linked id of each id, by comparing all that share a shingle."""
    of_shingle = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            of_shingle[g].append(k)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        both = Counter(o for g in s for o in of_shingle[g] if o < k)
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    return {k: root(k) for k in sets}


def shingles(text, n):
    own = [w.lower() for w in words(text)]
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def test_minhash(spark, sf_dir, rows):
    sets = {r.doc_id: shingles(r.text, 4) for r in rows}
    want = plain_components(sets, 80)
    found = queries.op10_minhash_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        k: (len(s), want[k], want[k] == k) for k, s in sets.items()
    }


def test_exact_topk(spark, sf_dir):
    data = sorted(queries.table(spark, sf_dir, "embeddings").collect(), key=lambda r: r.vec_id)
    ids = np.array([r.vec_id for r in data])
    v = np.floor(256 * np.array([r.embedding for r in data], float)).astype(np.int64)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        score = v @ v[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want |= {(int(ids[i]), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(order)}
    assert {tuple(r) for r in queries.op9_exact_topk(spark, sf_dir).collect()} == want


def test_neighbours_recall(spark, sf_dir):
    data = sorted(queries.table(spark, sf_dir, "embeddings").collect(), key=lambda r: r.vec_id)
    ids = np.array([r.vec_id for r in data])
    v = np.array([r.embedding for r in data], float)
    found = defaultdict(dict)
    for r in queries.op3_cross_polytope_ann(spark, sf_dir).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    queries_at = np.flatnonzero(ids % 20 == 0)
    for i in queries_at:
        score = v @ v[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        got = [found[ids[i]][n] for n in range(1, 21)]
        assert all(abs(s - score[np.searchsorted(ids, j)]) < 1e-12 for j, s in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        hits += len({j for j, _ in got} & {int(ids[j]) for j in order})
    assert hits >= 0.9 * 20 * len(queries_at)


def test_pseudonyms(spark, sf_dir, rows):
    found = {r.doc_id: r for r in queries.op4_pii_pseudonyms(spark, sf_dir).collect()}
    for r in rows:
        assert len(found[r.doc_id].text) == len(r.text)
        if not any(c in r.text for c in "0123456789@"):
            assert found[r.doc_id].text == r.text


def test_every_query_has_a_column_for_each_row(spark, sf_dir):
    n = queries.table(spark, sf_dir, "documents").count()
    frame = queries.op6_quality_classifier(spark, sf_dir)
    assert frame.count() == n and frame.where(F.col("score").isNull()).isEmpty()
