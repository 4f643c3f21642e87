"""Languages next to a plain Python version, and what the bounds of the model leave out."""

import math
import re
from collections import Counter, defaultdict

import pytest

from passbook.llm import language, queries
from test_operators import held_out


def words_of(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode())


def grams_of(word):
    chars = ["\x02", *word.decode(), "\x03"]
    for n in range(1, 5):
        for i in range(len(chars) - n + 1):
            yield n, i, "".join(chars[i : i + n])


class Plain:
    def __init__(self, rows):
        count = defaultdict(Counter)
        priors = Counter()
        for text, lang in rows:
            priors[lang] += 1
            for w in words_of(text):
                count[0, lang][w] += 1
                for n, _, g in grams_of(w):
                    count[n, lang][g] += 1
        self.langs = sorted(priors)
        self.priors = [math.log(priors[v] + 1) for v in self.langs]
        self.logs = {}
        for o in range(5):
            all_ = sum((count[o, v] for v in self.langs), Counter())
            kept = [k for k, n in all_.items() if n >= 2]
            whole = {v: count[o, v].total() for v in self.langs}
            self.logs[o] = {
                k: [math.log((count[o, v][k] + 0.5) / (whole[v] + 0.5 * max(1, len(kept)))) for v in self.langs] for k in kept
            }

    def word(self, w):
        if w in self.logs[0]:
            return self.logs[0][w]
        found = defaultdict(dict)
        for n, i, g in grams_of(w):
            if g in self.logs[n]:
                found[i][n] = self.logs[n][g]
        size = len(w.decode()) + 2
        best = [found[i][max(found[i])] for i in range(size) if found[i]]
        return [sum(b[k] for b in best) / size for k in range(len(self.langs))]

    def predict(self, text):
        score = list(self.priors)
        for w in words_of(text):
            score = [a + b for a, b in zip(score, self.word(w), strict=True)]
        best = max(score)
        return self.langs[score.index(best)], 1 / sum(math.exp(s - best) for s in score)


def test_language_equals_plain(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").collect()
    plain = Plain([(r.text, r.lang) for r in rows if r.lang is not None and r.text is not None and not held_out(r.doc_id)])
    for r in queries.op1_language_id(spark, sf_dir).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        if words_of(text):
            lang, score = plain.predict(text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_bounds_leave_out_rare_words_and_long_grams(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    whole = language.learn(docs)
    assert whole.left_out == (0, 0)
    with pytest.warns(UserWarning, match="beyond the bounds"):
        small = language.learn(docs, most_words=50, most_grams=60)
    assert len(small.tables[0].keys) == 50 and len(small.tables[1].keys) > 20
    assert small.left_out[0] == len(whole.tables[0].keys) - 50
    assert not len(small.tables[4].keys)


def test_a_rare_language_is_learned(spark):
    """One row in 2,000 has the rare language; a sample of 100 rows still holds it."""
    rows = [(i, f"the cat and the dog number w{i}", "en") for i in range(2000)] + [(5000, "ein hund und eine katze katze hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, sample_rows=100)
    assert model.languages == ["de", "en"]
    assert model.priors[1] > model.priors[0] + 6


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(i, "same words here", lang) for i, lang in ((1, "fr"), (3, "en"), (4, "fr"), (5, "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    assert {r.lang_pred for r in got} <= {"en", "fr"}
    learned = [lang for i, _, lang in rows if not held_out(i)]
    if learned.count("en") == learned.count("fr"):
        assert {(r.lang_pred, r.score) for r in got} == {("en", 0.5)}
