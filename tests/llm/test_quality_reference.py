"""The ordinal fit and its scores against plain dense models."""

import math
import zlib

import numpy as np
import pytest

from lumenframe.llm import quality


def made_rows(seed, n=90):
    """Words 1-4 lower the grade, 5-8 raise it, the others say nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        g = int(rng.integers(3))
        some = [i for i in range(40) if rng.random() < (0.8 - 0.35 * g if 1 <= i <= 4 else 0.1 + 0.35 * g if 5 <= i <= 8 else 0.3)]
        rows.append((np.array(some, np.int32), rng.random(quality.DENSE), g))
    return rows


def plain_loss(theta, rows, used, ridge, weight):
    """The penalised likelihood as it is stated, row by row over dense vectors."""
    w, a, t0 = theta[: len(used)], theta[len(used) : -2], theta[-2]
    t1, loss = t0 + math.exp(theta[-1]), 0.0
    for (buckets, x, g), share in zip(rows, weight, strict=True):
        z = sum(w[k] for k, b in enumerate(used) if b in buckets) + sum(float(u) * float(v) for u, v in zip(a, x, strict=True))
        below = [1 / (1 + math.exp(z - t0)), 1 / (1 + math.exp(z - t1)), 1.0]
        loss -= share * math.log(below[g] - (below[g - 1] if g else 0.0))
    return loss + 0.5 * sum(r * v * v for r, v in zip(ridge, theta[:-2], strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_objective_equals_the_plain_likelihood(seed):
    rows, used = made_rows(seed, 40), list(range(12))
    rng = np.random.default_rng(seed)
    grades = np.array([g for _, _, g in rows])
    weight = rng.random(40)
    ridge = rng.random(len(used) + quality.DENSE)
    theta = rng.normal(size=len(used) + quality.DENSE + 2)
    pairs = [(k, i) for i, (b, _, _) in enumerate(rows) for k, u in enumerate(used) if u in b]
    col, own = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    x = np.stack([d for _, d, _ in rows])
    loss, grad = quality.objective(theta, col, own, x, grades, weight, ridge)
    assert loss == pytest.approx(plain_loss(theta, rows, used, ridge, weight))
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        slope = (plain_loss(theta + e, rows, used, ridge, weight) - plain_loss(theta - e, rows, used, ridge, weight)) / 2e-5
        assert grad[i] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_fit_reaches_the_least_loss_of_a_plain_descent():
    rows = made_rows(7)
    model = quality.fit(rows, least_chi2=8.0, rounds=1500)
    used = np.flatnonzero(model.weights).tolist()
    assert set(range(1, 9)) & set(used) and (model.weights > 0).any() and (model.weights < 0).any()
    grades = np.array([g for _, _, g in rows])
    weight = np.bincount(grades)[grades] ** -0.5
    weight = weight / weight.sum()
    raising = [np.mean([g for b, _, g in rows if u in b]) >= grades.mean() for u in used]
    ridge = np.array([1e-2 if r else 1e-4 for r in raising] + [1e-4] * quality.DENSE)
    got = np.concatenate([model.weights[used], model.dense_weights, [model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]])
    # dense Newton steps with a numeric Hessian, from zero
    pairs = [(k, i) for i, (b, _, _) in enumerate(rows) for k, u in enumerate(used) if u in b]
    args = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.stack([d for _, d, _ in rows]), grades, weight, ridge
    theta = np.zeros(len(got))
    theta[-2] = -1.0
    for _ in range(200):
        _, grad = quality.objective(theta, *args)
        hess = np.stack([(quality.objective(theta + 1e-5 * e, *args)[1] - quality.objective(theta - 1e-5 * e, *args)[1]) / 2e-5 for e in np.eye(len(theta))])
        theta = theta - 0.3 * np.linalg.solve(hess + 1e-3 * np.eye(len(theta)), grad)
    least = plain_loss(theta, rows, used, ridge, weight)
    assert plain_loss(got, rows, used, ridge, weight) <= least * 1.01 + 1e-4


def plain_latent(model, text):
    """Word by word, every bucket once."""
    text = text or ""
    words = ["".join(c) for c in _runs(text.lower())]
    hit = set()
    for w in words:
        hit.add(zlib.crc32(w.encode()) % quality.DIMENSIONS)
        for k in range(3, 8):
            if k < len(w):
                hit.add(zlib.crc32((w[:k] + "~").encode()) % quality.DIMENSIONS)
    x = quality.dense(text, len(words), len(set(words)))
    return sum(float(model.weights[b]) for b in hit) + sum(float(a) * b for a, b in zip(model.dense_weights, x, strict=True))


def _runs(text):
    out = [[]]
    for c in text:
        if c.isalnum() and not c.isdigit() and not c.isdecimal() and not c.isnumeric() or (c.isalpha()):
            out[-1].append(c)
        elif out[-1]:
            out.append([])
    return [r for r in out if r]


def test_scores_equal_the_plain_model(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(quality.training_rows(docs, labels, "doc_id", "text", 6_000))
    for r in quality.score(docs, labels).collect():
        z = plain_latent(model, texts[r.doc_id])
        below = [1 / (1 + math.exp(max(-40, min(40, z - t)))) for t in model.thresholds]
        assert r.p_top == pytest.approx(1 - below[1], abs=1e-6)
        assert r.expected_grade == pytest.approx((below[1] - below[0]) + 2 * (1 - below[1]), abs=1e-6)
        assert r.keep == (r.p_top >= 0.5)
