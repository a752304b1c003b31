import math
import zlib

import numpy as np
import pytest

from millrace.llm import quality as q
from millrace.session import table


def test_held_out_accuracy(spark, sf01):
    labels = table(spark, sf01, "labels")
    out = q.quality(table(spark, sf01, "documents"), labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_weights_order_pairs():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.6).astype(float)
    x = rng.normal(size=(400, 3)) + np.outer(y, [3.0, 0.0, -3.0])
    model = q.fit_pairs(x, y)
    assert model.weights[0] > 0 > model.weights[2] and abs(model.weights[1]) < 0.5
    scores = model.scores(x)
    assert scores[y == 1].mean() > 0.8 and ((scores >= q.THRESHOLD) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize(("y", "expected"), [([], 1.0), ([1, 1], 1.0), ([0], 0.0)])
def test_one_class(y, expected):
    model = q.fit_pairs(np.zeros((len(y), 3)), np.array(y, float))
    assert (model.scores(np.ones((2, 3))) == expected).all()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.quality(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert q.quality(odd_docs.limit(0), labels.limit(0)).count() == 0
    kept = q.classify(odd_docs, q.fit_pairs(np.zeros((0, len(q.FEATURES))), np.zeros(0)))
    assert sorted(kept.columns) == sorted(odd_docs.columns)


def plain_features(text):
    text = text or ""
    words, raw = text.split(), text.encode()
    if not words:
        return [0.0] * 9 + [1.0]
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    lines = [x for x in text.split("\n") if x]
    shares = [
        sum(chr(b) in "#$%&*+/<=>@\\^_`{|}~[]" for b in raw) / len(raw),
        raw.count(b"!") / len(raw),
        upper / max(1, upper + lower),
        sum(48 <= b <= 57 for b in raw) / len(raw),
        sum(a == b for a, b in zip(words, words[1:])) / len(words),
        max(0.0, 1 - math.log1p(len(set(words))) / math.log1p(len(words))),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(raw) / len(words) / 40),
        sum(not any(c.isalpha() for c in w) for w in words) / len(words),
        0.0,
    ]
    return [math.sqrt(x) for x in shares]


def test_query_against_plain_code(spark, sf01):
    """The whole query again: labels, features, Bradley-Terry weights, the cut among all quantiles, scores."""
    docs, labels = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    train = sorted(i for i in texts if i in known and not held[i] and texts[i] is not None)
    x, y = np.array([plain_features(texts[i]) for i in train]), np.array([known[i] for i in train], float)
    model = q.fit_pairs(x, y)
    # the weights are where the gradient of the pairs' logistic loss vanishes
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    rng = np.random.default_rng(11)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, q.PAIRS)] - z[rng.choice(bad, q.PAIRS)]
    gradient = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(0) + 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-6
    # no cut between two training scores separates the classes better
    raw = z @ model.weights
    balanced = lambda c: ((raw > c) == (y == 1))[y == 1].mean() + ((raw > c) == (y == 1))[y == 0].mean()
    assert balanced(model.cut) >= max(map(balanced, raw)) - 1e-12
    got = {r.doc_id: r for r in q.quality(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        value = sum(w * (f - a) / b for w, f, a, b in zip(model.weights, plain_features(text), model.mean, model.scale))
        score = 1 / (1 + math.exp(-min(60.0, max(-60.0, model.slope * (value - model.cut) + math.log(0.7 / 0.3)))))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].held_out == held[i]
        assert got[i].predicted == int(got[i].score >= 0.7)
