"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from passbook.llm import queries
from passbook.session import saved, shared_dir
from test_operators import plain_components, shingles


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = saved(stage(spark, given, sf_dir), shared_dir(spark, "stage"))
        seen[name] = (given, docs)
        if name != "pack":
            assert docs.columns == given.columns
    given, kept = seen["quality"]
    wanted = {r.doc_id for r in queries.op6_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted
    given, kept = seen["near copies"]
    root = plain_components({r.doc_id: shingles(r.text, 5) for r in given.collect()}, 80)
    assert {r.doc_id for r in kept.collect()} == set(root.values())
    given, kept = seen["mix"]
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in given.collect()}
    given, packed = seen["pack"]
    assert packed.where("start = 0").count() == given.count()


def test_stages_on_odd_rows_and_on_none(spark, sf_dir):
    """Nulls, empty texts, repeats, columns with names that the stages use, and no rows at all."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, text, "en", None), (4, text, "en", "b"), (4, text, "en", "b"),
        (None, text + " more", "en", "b"), (7, "call 212-555-0143 now", "en", "a"), (8, text[::-1], "de", "b"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, component long, score double, ids string"
    odd = spark.createDataFrame([(*r, len(r[1] or ""), 1, 1, 0.5, "x") for r in rows], schema)
    for given in (odd, odd.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, sf_dir), shared_dir(spark, "stage"))
            if name != "pack":
                assert docs.columns == given.columns
            if name == "near copies":
                assert docs.where("doc_id = 3").count() + docs.where("doc_id = 4").count() <= 1
        assert given.isEmpty() <= docs.isEmpty()
