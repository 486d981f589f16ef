import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import language_crf as crf
from tests.llm.common import documents, empty, frame, odd


@pytest.fixture(scope="module")
def fitted(spark, data):
    docs = documents(spark, data)
    return docs, crf.fit(docs)


def test_posteriors_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    emissions, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([True, False, False, True, False, False, False])
    want = np.zeros((7, 3))
    for y in itertools.product(range(3), repeat=7):
        s = sum(emissions[i, y[i]] for i in range(7)) + sum(moves[y[i - 1], y[i]] for i in range(1, 7) if not first[i])
        for i in range(7):
            want[i, y[i]] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(crf.posteriors(emissions, moves, first), want)


def test_posteriors_over_block_cuts():
    rng = np.random.default_rng(4)
    n = 3 * crf._BLOCK + 17
    emissions, moves = rng.normal(size=(n, 3)), 2 * rng.normal(size=(3, 3))
    first = np.zeros(n, dtype=bool)
    first[[0, 5, 700]] = True
    alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
    pot, m = np.exp(emissions), np.exp(moves)
    for i in range(n):
        alpha[i] = pot[i] * (1 if first[i] else alpha[i - 1] @ m)
        alpha[i] /= alpha[i].sum()
    for i in range(n - 2, -1, -1):
        ahead = pot[i + 1] * beta[i + 1]
        beta[i] = ahead.sum() if first[i + 1] else m @ ahead
        beta[i] /= beta[i].sum()
    want = alpha * beta
    assert np.allclose(crf.posteriors(emissions, moves, first), want / want.sum(axis=1, keepdims=True))


def test_gradient_is_the_slope_of_the_likelihood():
    model = crf.train({"aa": ["one two three", "two four"], "bb": ["uno dos tres", "dos quatro"]}, sequences=20, rounds=1)
    data, bounds = crf.lowered(["one two uno dos", "tres four"])
    starts, ends, wb = crf.spans.runs(crf.WORD[data], bounds)
    f = crf.features(data, starts, ends, model.lexicon)
    y, parts = np.array([0, 0, 1, 1, 1, 0]), [(0, 4), (4, 6)]
    model.weights = model.weights.astype(np.float64)

    def loss():
        e, total = model.emissions(f), 0.0
        for a, b in parts:
            all_ = [
                sum(e[a + i, s[i]] for i in range(b - a)) + sum(model.transitions[s[i - 1], s[i]] for i in range(1, b - a))
                for s in itertools.product(range(2), repeat=b - a)
            ]
            own = sum(e[i, y[i]] for i in range(a, b)) + sum(model.transitions[y[i - 1], y[i]] for i in range(a + 1, b))
            total += np.logaddexp.reduce(all_) - own
        return total

    grad_w, grad_t = crf._gradient(model, f, y, parts)
    for array, grad, at in ((model.weights, grad_w, (f.rows[3], 1)), (model.transitions, grad_t, (0, 1)), (model.transitions, grad_t, (1, 1))):
        base = array[at]
        array[at] = base + 1e-5
        up = loss()
        array[at] = base - 1e-5
        down = loss()
        array[at] = base
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_held_out_languages(fitted):
    docs, model = fitted
    got = crf.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in {*model.languages, crf.UNDETERMINED}
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95


def test_words_of_mixed_text(fitted, spark):
    docs, model = fitted
    text = {r.lang: r.text for r in docs.filter("lang IN ('de', 'fr') AND n_chars > 600").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    clean = {k: " ".join(w for w in v.split() if w.strip(".,").isalpha()) for k, v in text.items()}
    mixed = " ".join(clean["de"].split()[:40] + clean["fr"].split()[:40])
    labels = crf.word_labels(frame(spark, [mixed, None]), model).orderBy("doc_id").collect()
    assert sum(x == "de" for x in labels[0].labels[:40]) >= 36 and sum(x == "fr" for x in labels[0].labels[-40:]) >= 36
    assert labels[1].labels == []


def test_held_out_labels_change_nothing(fitted):
    docs, model = fitted
    turned = docs.withColumn("lang", F.when(crf.held_out("doc_id", 4, 2), "zz").otherwise(F.col("lang")))
    again = crf.fit(turned)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)


def test_odd_rows(fitted, spark):
    docs, model = odd(spark), fitted[1]
    got = {(r.doc_id, r.lang_pred, r.score) for r in crf.predict(docs, model).collect()}
    und = {i for i, lang, score in got if lang == crf.UNDETERMINED and score == 0}
    assert {1, 2, 3, 6} <= und and not und & {4, 5, 8, 9, 16}
    out = crf.accepted(docs, model, 0.0)
    assert out.columns == docs.columns and out.filter("text IS NULL OR text = ''").count() == 0
    assert crf.fit(docs).languages == ["de", "en"]
    assert crf.fit(empty(spark)) is None
    assert {r.lang_pred for r in crf.predict(docs, None).collect()} == {crf.UNDETERMINED}
    assert crf.predict(empty(spark), model).count() == 0
    assert crf.accepted(docs, None).filter("doc_id = 6").count() == 0
