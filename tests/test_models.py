"""The models against dense oracles, Newton steps in numpy, and literal fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridforge.functions import normal as N
from gridforge.models import logistic, space_time
from gridforge.models import state_space as S


def test_normal_distribution():
    z = np.concatenate([np.linspace(-37, 8, 4001), [0.0, 3.0, -3.0]])
    want = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    assert np.allclose(N.cdf(z), want, rtol=1e-10, atol=0)
    assert np.isclose(N.log_cdf([-50.0])[0], -0.5 * 2500 - 0.5 * np.log(2 * np.pi) - np.log(50) - 1 / 2500, atol=1e-4)


def test_normal_column(spark):
    got = [r.p for r in spark.createDataFrame([(0.0,), (None,), (1.0,)], "z double").select(N.cdf_column(F.col("z")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None and got[2] == pytest.approx(0.8413447460685429)


def test_expected_log_probit_derivatives():
    y, m, v, e = np.array([0, 1, 1]), np.array([0.3, -1.2, 2.0]), np.array([0.5, 1.5, 0.1]), 1e-5
    value, by_mean, by_var = N.expected_log_probit(y, m, v, 40)
    assert np.allclose(by_mean, (N.expected_log_probit(y, m + e, v, 40)[0] - N.expected_log_probit(y, m - e, v, 40)[0]) / (2 * e), atol=1e-7)
    assert np.allclose(by_var, (N.expected_log_probit(y, m, v + e, 40)[0] - N.expected_log_probit(y, m, v - e, 40)[0]) / (2 * e), atol=1e-7)
    draws = m[:, None] + np.sqrt(v)[:, None] * np.random.default_rng(1).normal(size=(3, 400000))
    assert np.allclose(value, N.log_cdf((2 * y - 1)[:, None] * draws).mean(1), atol=0.01)


def test_kernel_and_transition_agree():
    for step in (0.0, 0.25, 1.0, 2.5):
        a, p = S.transition(step, 1.5), S.stationary(1.5, 0.7)
        assert (a @ p)[0, 0] == pytest.approx(S.covariance([step], [0.0], 1.5, 0.7)[0, 0], abs=1e-10)
        assert np.linalg.eigvalsh(S.process_noise(step, 1.5, 0.7)).min() > -1e-10


def test_kernel_column(spark):
    got = spark.createDataFrame([(0.0, 2.5)], "a double, b double").select(S.covariance_column(F.col("a"), F.col("b"), 1.5, 2.0).alias("k")).first().k
    assert got == pytest.approx(S.covariance([0.0], [2.5], 1.5, 2.0)[0, 0])


def dense(times, values, noises, lengthscale, variance):
    k = S.covariance(times, times, lengthscale, variance)
    seen = k + np.diag(noises)
    mean = k @ np.linalg.solve(seen, values)
    log = -0.5 * (values @ np.linalg.solve(seen, values) + np.linalg.slogdet(seen)[1] + len(values) * np.log(2 * np.pi))
    return mean, np.diag(k - k @ np.linalg.solve(seen, k)), log


def test_smoother_equals_dense_process():
    times, values = np.array([0, 0.4, 1, 2.25, 4]), np.array([0.2, -0.1, 0.35, 0.05, -0.25])
    for got, want in zip(S.smooth_one(times, values, [0.15] * 5, 1.5, 1.0), dense(times, values, [0.15] * 5, 1.5, 1.0), strict=True):
        assert np.allclose(got, want, atol=1e-10)


def test_series_with_repeated_times_hot_key_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(1, float(rng.integers(4)), float(rng.normal())) for _ in range(300)] + [(2, 0.0, 1.0), (2, 1.5, -1.0), (2, None, 3.0), (2, 2.0, None), (3, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    got = S.smooth_series(df, ["k"], "t", "v", 0.2, 1.3, 0.8).toPandas()
    assert list(got.columns) == ["k", "t", "n", "mean", "variance"] and len(got) == 7
    for k in (1, 2, 3):
        mine = sorted(r for r in rows if r[0] == k and None not in r)
        mean, var, _ = dense([r[1] for r in mine], np.array([r[2] for r in mine]), [0.2] * len(mine), 1.3, 0.8)
        want = {r[1]: (a, b) for r, a, b in zip(mine, mean, var, strict=True)}
        for r in got[got.k == k].itertuples():
            assert np.allclose((r.mean, r.variance), want[r.t], atol=1e-8)
    assert S.smooth_series(df.limit(0), ["k"], "t", "v", 0.2, 1.3, 0.8).count() == 0


def newton(x, y, c):
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    keep = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + keep, c * x.T @ (y - p) - keep @ w)
    return w


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 900
    f = pd.DataFrame({"a": rng.normal(2, 3, n), "b": rng.normal(size=n), "flat": 4.0, "t": rng.integers(0, 3, n).astype(float), "x": rng.uniform(0, 10, n), "z": rng.uniform(0, 10, n)})
    f["y"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.6 * (f.a - 2) - f.b + np.sin(f.x))))).astype(int)
    return f


def test_logistic_equals_newton(spark, rows):
    model = logistic.fit(spark.createDataFrame(rows), ["a", "b", "flat"])
    x = rows[["a", "b", "flat"]].to_numpy()
    x = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    want = newton(x, rows.y.to_numpy(), 0.1)
    assert np.allclose([model.intercept, *model.weights], want, atol=1e-5)
    assert model.odds()[0][2] == pytest.approx(math.exp(want[1]), abs=1e-4)


def test_logistic_refuses_bad_rows(spark):
    names = "a double, y int"
    for bad in ([(1.0, 0), (2.0, 0)], [(None, 0), (1.0, 1)], [(float("nan"), 0), (1.0, 1)], [(1.0, 2), (0.0, 1)], [(1.0, None), (0.0, 1), (0.5, 0)]):
        with pytest.raises(ValueError):
            logistic.fit(spark.createDataFrame(bad, names), ["a"])
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame([], names), ["a"])


def test_rolling_folds_learn_from_the_past(spark, rows):
    df = spark.createDataFrame(rows)
    scored = logistic.rolling(df, "t", [0, 1, 2], ["a", "b"])
    assert {r.origin for r in scored.select("origin").distinct().collect()} == {1.0, 2.0} and scored.count() == (rows.t > 0).sum()
    metrics = {r.fold: r for r in logistic.fold_metrics(scored).collect()}
    assert metrics[1].prevalence == pytest.approx(rows.y[rows.t == 0].mean()) and all(m.roc_auc > 0.7 and m.brier < m.prevalence_brier for m in metrics.values())
    best, losses = logistic.choose_c(df.filter("t = 0"), df.filter("t = 1"), ["a", "b"])
    assert best == min(losses, key=lambda x: x[1])[0]


def test_inducing_grid():
    got = space_time.inducing_grid(np.array([[0.0, 1.0], [2.0, 3.0]]), [1, 0, 1])
    assert got.tolist() == [[0, 1, 0], [2, 3, 0], [0, 1, 1], [2, 3, 1]]


def test_block_filter_equals_dense_process():
    points, times = np.array([[0.0, 0.0], [1.0, 0.0], [0.5, 1.0]]), np.array([0.0, 0.7, 1.8])
    rng = np.random.default_rng(5)
    model = space_time.SpaceTime.start(points, times, 0, (1.0, 2.0), 1.5, 0.9)
    model.site_vector = rng.normal(size=(3, 3))
    model.site_matrix = np.stack([a @ a.T + np.eye(3) for a in rng.normal(size=(3, 3, 3))])
    model = model.solved()
    prior = np.kron(S.covariance(times, times, 1.5, 0.9), model._kzz())
    precision = np.linalg.inv(prior)
    for t in range(3):
        precision[3 * t : 3 * t + 3, 3 * t : 3 * t + 3] += model.site_matrix[t]
    cov = np.linalg.inv(precision)
    mean = cov @ model.site_vector.ravel()
    assert np.allclose(model.path.means[:, :3].ravel(), mean, atol=1e-8)
    for t in range(3):
        assert np.allclose(model.path.covariances[t, :3, :3], cov[3 * t : 3 * t + 3, 3 * t : 3 * t + 3], atol=1e-8)
    # what the sites cost is the divergence from the prior, with its sign turned
    k = len(mean)
    kl = 0.5 * (np.trace(np.linalg.solve(prior, cov)) + mean @ np.linalg.solve(prior, mean) - k + np.linalg.slogdet(prior)[1] - np.linalg.slogdet(cov)[1])
    assert model.log_prior == pytest.approx(-kl, abs=1e-7)


def test_space_time_fit(spark, rows):
    df = spark.createDataFrame(rows)
    points = space_time.inducing_points(df, "x", "z", k=12)
    model = space_time.fit(df.filter("t < 2"), "t", "x", "z", ["a", "b"], "y", points, lengthscales=(2.0, 2.0), rounds=6)
    assert len(points) == 12 and len(model.history) == 7 and all(b > a - 1e-6 for a, b in zip(model.history, model.history[1:], strict=False))
    got = space_time.predict(df, model, "t", "x", "z", ["a", "b"], ["t", "y"]).toPandas()
    later = got[got.t == 2]
    assert len(got) == len(rows) and later.p.between(0, 1).all()
    base = rows.y[rows.t < 2].mean()
    assert ((later.p - later.y) ** 2).mean() < 0.85 * ((base - later.y) ** 2).mean()
    broken = spark.createDataFrame([(2.0, 1.0, None, 0.0, 0.0, 1)], "t double, x double, z double, a double, b double, y int")
    assert space_time.predict(broken, model, "t", "x", "z", ["a", "b"], ["y"]).first().p is None
    with pytest.raises(ValueError):
        space_time.fit(broken, "t", "x", "z", ["a", "b"], "y", points)
    with pytest.raises(ValueError):
        model.at(0.5)


def test_registered_inducing_points_are_the_whole_grid(spark):
    from gridforge.plans import queries, views

    sf = "/root/testdata/sf0.01"
    epochs = {r.epoch for r in views.cells(spark, sf).select("epoch").distinct().collect()}
    got = queries.QUERIES["inducing_points"](spark, sf).collect()
    assert {r.time for r in got} == epochs and len(got) == 64 * len(epochs)


def test_cvi_gate(spark):
    from gridforge.models import cvi

    times, y = np.array([0, 0.5, 1.2, 2.0, 3.3]), np.array([[0, 1, 1, 0, 1.0]])
    sites, bounds = cvi.Sites.start(1, 5, 1e-3), []
    for _ in range(25):
        bounds.append(cvi.bound(times, sites, y, 1 - y, 1.5, 1.0, 40)[0])
        values, noises = sites.observations()
        mean, var = S.smooth_stack(times, values, noises, 1.5, 1.0)
        want = dense(times, values[0], noises[0], 1.5, 1.0)
        assert np.allclose(mean[0], want[0], atol=1e-10) and np.allclose(var[0], want[1], atol=1e-10)
        k = S.covariance(times, times, 1.5, 1.0)
        cov = k - k @ np.linalg.solve(k + np.diag(noises[0]), k)
        divergence = 0.5 * (np.trace(np.linalg.solve(k, cov)) + mean[0] @ np.linalg.solve(k, mean[0]) - 5 + np.linalg.slogdet(k)[1] - np.linalg.slogdet(cov)[1])
        assert bounds[-1] == pytest.approx(cvi.likelihood(y, 1 - y, mean, var, 40)[0].sum() - divergence, abs=1e-8)
        _, g, h = cvi.likelihood(y, 1 - y, mean, var, 40)
        sites = cvi.moved(sites, cvi.moment_gradients(mean, g, h), 0.2)
    assert bounds == sorted(bounds) and bounds[-1] - bounds[0] > 0.5
    with pytest.raises(ValueError):
        cvi.Sites.start(1, 1, 0.0)
    rows = [("a", float(t), int(v)) for t, v in zip(times, y[0], strict=True)] + [("b", 0.0, 1), ("b", 0.0, 1), ("b", None, 1), ("b", 1.0, None)]
    got = cvi.smooth_labels(spark.createDataFrame(rows, "k string, t double, y int"), ["k"], "t", "y", 1.5, 1.0).toPandas()
    _, mean, _ = cvi.fit(times, y, 1 - y, 1.5, 1.0)
    assert np.allclose(got[got.k == "a"].sort_values("t")["mean"], mean[0]) and got[got.k == "b"][["ones", "zeros"]].values.tolist() == [[2, 0]]
    with pytest.raises(Exception, match="0 or 1"):
        cvi.smooth_labels(spark.createDataFrame([("a", 0.0, 2)], "k string, t double, y int"), ["k"], "t", "y", 1.5, 1.0).collect()


def test_stack_equals_single_series():
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.uniform(0.1, 2, 8))
    values, noises = rng.normal(size=(5, 8)), rng.uniform(0.1, 1, (5, 8))
    mean, var = S.smooth_stack(times, values, noises, 1.5, 0.7)
    for k in range(5):
        one = S.smooth_one(times, values[k], noises[k], 1.5, 0.7)
        assert np.allclose(mean[k], one[0], atol=1e-12) and np.allclose(var[k], one[1], atol=1e-12)


def test_continuous_matrices_are_those_of_the_steps():
    f, l, q, h = S.continuous_matrices(1.5, 0.7)
    stationary = S.stationary(1.5, 0.7)
    assert np.allclose(f @ stationary + stationary @ f.T + q * l @ l.T, 0, atol=1e-12) and np.allclose(h @ stationary @ h.T, 0.7)
    small = 1e-6
    assert np.allclose((S.transition(small, 1.5) - np.eye(2)) / small, f, atol=1e-4)
