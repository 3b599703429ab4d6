"""Toxicity's score and fit against plain loops; token counts of no documents."""

import math

import numpy as np

from lodestar.llm import token_counts, toxicity


def letter(c):
    code = ord(c)
    return code - 96 if "a" <= c <= "z" else 27 + code % (toxicity.CLASSES - 27) if code > 170 else 0


def value_of(unit, weights):
    """Sum of the weights of all gapped triples of letters over the root of the unit's own kernel."""
    total, own = 0.0, {}
    for i in range(len(unit)):
        for j in range(i + 1, len(unit)):
            for k in range(j + 1, len(unit)):
                a, b, d = letter(unit[i]), letter(unit[j]), letter(unit[k])
                if k - i < toxicity.SPAN and a and b and d:
                    code = (a * toxicity.CLASSES + b) * toxicity.CLASSES + d
                    decay = toxicity.DECAY ** (k - i - 1)
                    total += decay * float(weights[code])
                    own[code] = own.get(code, 0.0) + decay
    return total / math.sqrt(sum(v * v for v in own.values()) + 1e-12)


def training():
    words = "the river runs along green fields while people walk home and talk about weather".split()
    text = lambda i, bad: " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12)) + (" scumbag" if bad and i % 4 else " morons" if bad else "")
    return [(int(i % 5 == 0), text(i, i % 5 == 0)) for i in range(200)]


def test_scores_match_a_loop():
    model = toxicity.fit(training())
    texts = ["you scumbag", "the s.c.u.m.b.a.g walks", "the river", "", "s c u m b a g", "m0rons at home", "mo rons at home", "é" * 70, "x" * 60 + " green", "Über moròns"]
    got = model.scores(texts)
    for t, s in zip(texts, got):
        worst = max((value_of(u, model.weights) for u in toxicity.units(t)), default=-2.0)
        z = min(30.0, max(-30.0, model.slope * worst + model.shift))
        assert abs(s - 1 / (1 + math.exp(-z))) < 2e-5
    by = dict(zip(texts, got))
    assert min(by["you scumbag"], by["s c u m b a g"], by["the s.c.u.m.b.a.g walks"]) > 0.3 > max(by["the river"], by[""])


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(0)
    z, weight, c = rng.normal(size=(80, 5)), rng.random(80) * 3, 10.0
    y = np.where(z[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    one = np.hstack([z, np.ones((80, 1))])

    def loss(b):
        return 0.5 * b[:-1] @ b[:-1] + c * (weight * np.maximum(0, 1 - y * (one @ b)) ** 2).sum()

    beta = toxicity._svm(z, y, weight, steps=3000)
    best = np.zeros(6)
    step = 0.5
    while step > 1e-7:  # coordinate search
        moved = False
        for i in range(6):
            for d in (step, -step):
                while loss(best + d * np.eye(6)[i]) < loss(best) - 1e-12:
                    best, moved = best + d * np.eye(6)[i], True
        step = step if moved else step / 2
    assert loss(beta) <= loss(best) * 1.001


def test_sigmoid_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    goal = np.where(rng.random(300) < 1 / (1 + np.exp(-(2 * x - 1))), 0.98, 0.02)
    loss = lambda a, b: float(np.mean(np.logaddexp(0, a * x + b) - goal * (a * x + b)))
    slope, shift = toxicity._sigmoid(x, goal)
    assert loss(slope, shift) <= min(loss(a, b) for a in np.arange(0.5, 4, 0.05) for b in np.arange(-3, 2, 0.05)) + 1e-5


def test_token_counts_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert token_counts.count_tokens(none).count() == 0
