"""Probes against numpy: the same minimum, and the same losses step by step."""

import numpy as np
import pytest

from strandline.operators import probes


def sample(n=400, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) + np.abs(x[:, 0]) + rng.normal(size=n) > 0.5).astype(int)
    return x, y


def frame(spark, x, y, parts=5):
    return spark.createDataFrame([(v.tolist(), int(b)) for v, b in zip(x, y, strict=True)], "features array<double>, label int").repartition(parts)


def test_newton_equals_numpy(spark):
    x, y = sample()
    one = np.concatenate([x, np.ones((len(x), 1))], 1)
    for m in probes.logistic(frame(spark, x, y), (1e-3, 1.0, 10.0)):
        w = np.zeros(7)
        for _ in range(60):
            p = 1 / (1 + np.exp(-one @ w))
            own = np.append(w[:-1], 0)
            w = w - np.linalg.solve(m.c * (one * (p * (1 - p))[:, None]).T @ one + np.diag([1.0] * 6 + [1e-12]), m.c * one.T @ (p - y) + own)
        assert np.abs(m.weights - w).max() < 1e-6 and m.steps < 20
        z = one @ w
        assert m.loss == pytest.approx(m.c * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y).sum() + w[:-1] @ w[:-1] / 2, rel=1e-9)
        scored = frame(spark, x, y).select("features", m.probability("features").alias("prob")).collect()
        assert max(abs(r["prob"] - 1 / (1 + np.exp(-(np.array(r["features"]) @ w[:-1] + w[-1])))) for r in scored) < 1e-6


def test_newton_on_hard_tables(spark):
    x = np.array([[-1.0], [-0.5], [0.5], [1.0]] * 5)
    (apart,) = probes.logistic(frame(spark, 1000 * x, (x[:, 0] > 0).astype(int)), (10.0,))
    assert np.isfinite(apart.weights).all() and apart.weights[0] > 0
    assert all((m.weights == 0).all() for m in probes.logistic(frame(spark, x, (x[:, 0] > 0).astype(int)).limit(0)))
    with pytest.raises(Exception, match="labels 0 or 1"):
        probes.logistic(frame(spark, x, np.full(20, 2)))
    with pytest.raises(Exception, match="several lengths"):
        probes.logistic(spark.createDataFrame([([1.0], 0), ([1.0, 2.0], 1)], "features array<double>, label int"))


def loss_of(m, x, y, w):
    now = probes.Network(m.alpha, m.dims, m.hidden, w, [])
    w1, _, w2, _ = now.parts()
    z = now.logit(x)
    return (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y).mean() + m.alpha * ((w1**2).sum() + (w2**2).sum()) / (2 * len(x))


def test_network_equals_numpy(spark):
    x, y = sample(300, 4)
    for m in probes.networks(frame(spark, x, y), (1e-4, 50.0), hidden=5, steps=12, seed=7):
        w, first, second, losses = probes.initial(4, 5, 7), 0, 0, []
        for t in range(1, 13):
            losses.append(loss_of(m, x, y, w))
            g = np.array([(loss_of(m, x, y, w + e) - loss_of(m, x, y, w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8 / (1 - 0.999**t) ** 0.5)
        assert m.losses == pytest.approx(losses, rel=1e-4)
        again = probes.networks(frame(spark, x, y, 2), (m.alpha,), hidden=5, steps=12, seed=7)[0]
        assert again.losses == pytest.approx(m.losses, rel=1e-9)
        out = probes.network_probability(frame(spark, x, y).union(spark.createDataFrame([(None, 0)], "features array<double>, label int")), m).collect()
        assert all(r["prob"] is None if r["features"] is None else abs(r["prob"] - 1 / (1 + np.exp(-m.logit(np.array([r["features"]]))[0]))) < 1e-12 for r in out)


def test_the_first_of_the_best_is_chosen(spark):
    df = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.8, 0.2)], "label int, a double, b double")
    assert probes.chosen([df.withColumn("prob", df[c]) for c in ("b", "a", "a")]) == (1, [-1.0, 1.0, 1.0])
