"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passbook.llm import (
    ann,
    binary,
    components,
    language,
    minhash,
    mixing,
    packing,
    pii,
    quality,
    substring,
    topk,
)

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, cell string, score double, "
    "epochs int, cut int, known string, runs string, component long, ver long, ids string, l_id long, piece int"
)
LONG = " ".join(f"word{i}" for i in range(30_000))
COPY = " ".join(f"copy{i}" for i in range(40))


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, s, len(t or ""), 1, "x", 0.5, 1, 1, "k", "r", 1, 1, "i", 1, 1) for i, t, lang, s in rows], SCHEMA
    )


@pytest.fixture(scope="module")
def docs(spark):
    return table(
        spark,
        [
            (1, None, "en", "a"),
            (2, "", "en", None),
            (3, " \n\t ", None, "a"),
            (4, LONG, "en", "b"),
            (5, COPY, "en", "b"),
            (5, COPY, "en", "b"),
            (6, COPY, "fr", "b"),
            (None, COPY, "fr", None),
            (7, "one two", "fr", "c"),
            (8, "12 34 !!", "fr", "c"),
            (9, LONG, "en", "b"),
        ],
    )


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def labels(spark, rows=((1, 1), (2, 0), (4, 1), (5, None), (None, 1), (9, 1), (9, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_language(docs, none):
    found = by_id(language.identify(docs))
    assert sum(map(len, found.values())) == 11
    assert {found[i][0].lang_pred for i in (1, 2, 3, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for rs in found.values() for r in rs)
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mix(docs, none):
    found = by_id(mixing.mix(docs))
    assert [found[i][0].taken for i in (1, 2, 3)] == [0, 0, 0] and len(found[5]) == 2
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r.source: r.n for r in words} == {r.source: r.n for r in taken}
    assert mixing.mixed_documents(none).count() == 0


def test_resharing_stops_where_no_target_is_above_its_ceiling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert found["a"] == 20.0 and found[None] == 0.0
    assert sum(found.values()) == pytest.approx(1.5 * 2010)
    assert found["b"] == pytest.approx(2 * found["c"])


def test_quality(spark, docs, none):
    found = by_id(quality.classify(docs, labels(spark)))
    assert sum(map(len, found.values())) == 11
    assert quality.classify(none, labels(spark)).count() == 0
    assert {r.score for r in quality.classify(docs, labels(spark, [(77, 1)])).collect()} == {0.5}
    assert quality.accepted(docs, labels(spark)).columns == docs.columns


def test_minhash(docs, none):
    found = by_id(minhash.cluster(docs))
    assert [found[i][0].component_id for i in (1, 2, 3, 4, 5, 6, 7, 9)] == [1, 2, 3, 4, 5, 5, 7, 4]
    assert [found[i][0].n_shingles for i in (1, 2, 3, 7)] == [0, 0, 0, 1]
    assert found[None][0].component_id is None and found[None][0].kept and len(found[5]) == 2
    assert minhash.cluster(none).count() == 0
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8}


def test_minhash_links_through_chains_and_large_groups(spark):
    """A group where only neighbours are similar enough, and texts just outside of it."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        text = list(base)
        text[:k] = [f"v{i}" for i in range(k)]
        rows.append((100 + k, " ".join(text), "en", "a"))
    far = [f"u{i}" if i % 9 == 0 else w for i, w in enumerate(base)]
    rows.append((50, " ".join(far), "en", "a"))
    found = by_id(minhash.cluster(table(spark, rows)))
    assert {found[100 + k][0].component_id for k in range(60)} == {100}
    assert found[50][0].component_id == 50


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7), (100, 90)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[90] == 90
    assert components.components(edges.limit(0)).count() == 0


def test_substring(docs, none):
    found = by_id(substring.deduplicate(docs))
    assert [(r.n_words, r.n_removed) for r in found[5]] == [(40, 0), (40, 0)]
    assert (found[6][0].n_words, found[6][0].n_removed, found[6][0].kept_text) == (40, 40, "")
    assert (found[9][0].n_removed, found[4][0].n_removed, found[None][0].n_removed) == (30_000, 0, 0)
    assert (found[1][0].n_words, found[7][0].kept_text) == (0, "one two")
    assert [tuple(f) for f in found[9][0].factors] == [(0, 30_000, 4, 0)]
    assert substring.deduplicate(none).count() == 0


def test_substring_windows_that_meet_and_repeated_ids(spark):
    a, b = [f"a{i}" for i in range(13)], [f"b{i}" for i in range(13)]
    rows = [(1, " ".join([*a, "x"]), "", ""), (2, " ".join(["y", *b]), "", ""), (3, " ".join(["q", *a, *b[1:]]), "", "")]
    rows += [(3, " ".join(b), "", ""), (4, " ".join([*a[:12], "z"]), "", "")]
    found = by_id(substring.deduplicate(table(spark, rows)))
    assert sorted((r.n_words, r.n_removed) for r in found[3]) == [(13, 13), (26, 13)]
    assert found[4][0].n_removed == 0


def test_packing(docs, none):
    found = by_id(packing.packed_documents(docs, WORDS))
    assert [found[i][0].length for i in (1, 2, 3)] == [1, 1, 1]
    assert [r.piece for r in sorted(found[4], key=lambda r: r.piece)] == list(range(len(found[4])))
    assert len({(r.sequence_id, r.offset) for rs in found.values() for r in rs}) == sum(map(len, found.values()))
    assert packing.packed_documents(none, WORDS).count() == 0


def test_token_files(docs, none):
    found = binary.round_trip(docs, BYTES).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert found[0].start == 0
    assert all(x.start + x.n_tokens == y.start for x, y in zip(found, found[1:], strict=False))
    assert binary.round_trip(none, BYTES).count() == 0


def test_pseudonyms(spark, docs, none):
    found = pii.pseudonymise(docs, "key")
    assert found.columns == docs.columns and found.count() == 11 and pii.pseudonymise(none, "key").count() == 0
    assert found.where("doc_id = 1").first().text is None
    text = (
        "a.b@x.co 4111 1111 1111 1111 4111111111111112 +1 (334) 555-3192 1980-02-29 2023-02-30 "
        "31.12.1999 10.0.0.1 300.1.1.1 123-45-6789 000-11-2222 GB82WEST12345698765432 version 2.0"
    )
    rows = [(1, text, "", ""), (2, "b " + text, "", "")]
    first, second = (r.text for r in pii.pseudonymise(table(spark, rows), "key").orderBy("doc_id").collect())
    assert second == "b " + first and len(first) == len(text)
    for word in ("4111111111111112", "2023-02-30", "300.1.1.1", "000-11-2222", "version 2.0"):
        assert word in first
    for word in ("a.b@x.co", "4111 1111", "555-3192", "1980-02-29", "31.12.1999", "10.0.0.1", "123-45-6789", "GB82"):
        assert word not in first
    other = pii.pseudonymise(table(spark, rows), "other").first().text
    assert other != first


def test_pseudonyms_are_permutations(spark):
    rows = [(i, f"10.0.{i // 16}.{i % 16} 200-01-{i + 1000}", "", "") for i in range(160)]
    found = {tuple(r.text.split(" ")) for r in pii.pseudonymise(table(spark, rows), "key").collect()}
    assert len({a for a, _ in found}) == len({b for _, b in found}) == 160


VECTORS = [
    (0, [1.0, 0.0]),
    (20, [1.0, 0.0]),
    (50, [1.0, 0.0]),
    (1, [1.0, 0.0]),
    (1, [1.0, 0.0]),
    (100, None),
    (200, [0.0, 0.0]),
    (300, [float("nan"), 1.0]),
    (400, [None, 1.0]),
    (2, [0.6, 0.8]),
    (3, [-2.0, 0.5]),
    (None, [1.0, 1.0]),
]


def test_searches(spark):
    rows = spark.createDataFrame(
        [(i, v, 1, 2, 3) for i, v in VECTORS], "vec_id long, embedding array<float>, cid long, v int, score int"
    )
    found = topk.top(rows, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (0, 1, 1, 65536),
        (0, 2, 20, 65536),
        (0, 3, 50, 65536),
        (50, 1, 0, 65536),
        (50, 2, 1, 65536),
        (50, 3, 20, 65536),
        (200, 1, 0, 0),
        (200, 2, 1, 0),
        (200, 3, 2, 0),
    ]
    near = ann.nearest(rows, F.col("vec_id") % 20 == 0, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in near if r.query_id == 20] == [(20, 0), (20, 1), (20, 50), (20, 2)]
    assert {r.query_id for r in near} == {0, 20}
    assert topk.top(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_beyond_64_bits_raises(spark):
    rows = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top(rows, F.col("vec_id") == 0).collect()


def test_minhash_of_a_group_about_the_threshold(spark):
    """400 texts made from one by replacing some words: about half of the pairs are similar
    enough, many of the others by a shingle or two not."""
    from test_operators import plain_components, shingles

    draw = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in draw.sample(range(160), draw.choice([1, 3, 4, 5, 6, 8])):
            words[at] = draw.choice([f"x{draw.randrange(400)}", f"y{at}"])
        rows.append((k, " ".join(words), "en", "a"))
    for n in (4, 5):
        want = plain_components({i: shingles(text, n) for i, text, _, _ in rows}, 80)
        found = {r.doc_id: r.component_id for r in minhash.cluster(table(spark, rows), n).collect()}
        assert found == want
        assert 5 < len(set(want.values())) < 300
