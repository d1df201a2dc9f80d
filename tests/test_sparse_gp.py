"""The gradient-fitted process against finite differences, dense formulas and its own bound."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridforge.functions.normal import expected_log_probit
from gridforge.models import space_time
from gridforge.models import sparse_gp as G


def toy(n=40, m=6, seed=1, family="matern32"):
    rng = np.random.default_rng(seed)
    data = np.column_stack([rng.uniform(0, 4, (n, 2)), rng.integers(0, 3, n), rng.normal(size=(n, 2)), rng.integers(0, 2, n)])
    points = np.column_stack([rng.uniform(0, 4, (m, 2)), rng.integers(0, 3, m)])
    root = np.tril(rng.normal(0, 0.3, (m, m))) + np.eye(m)
    return data, G.Sparse(points, rng.normal(size=3), rng.normal(size=m), root, 1.3, 0.8, 1.7, 0.9, family)


def bound(model, data):
    return float(G.expected_likelihood(model, data)["value"][0]) - model.divergence()


@pytest.mark.parametrize("family", ["matern32", "matern12"])
def test_gradients_are_finite_differences(family):
    data, model = toy(family=family)
    by = G.carried(model, G.expected_likelihood(model, data))
    eps = 1e-5
    value = lambda m: float(G.expected_likelihood(m, data)["value"][0])
    for k, name in enumerate(G.LEARNT):
        up, down = (dataclasses.replace(model, **{name: getattr(model, name) * np.exp(s * eps)}) for s in (1, -1))
        assert by["settings"][k] == pytest.approx((value(up) - value(down)) / (2 * eps), rel=1e-5, abs=1e-6), name
    for name in ("mean", "beta", "root"):
        at = getattr(model, name)
        for place in np.ndindex(at.shape):
            if name == "root" and place[1] > place[0]:
                continue
            moved = [at.copy(), at.copy()]
            moved[0][place] += eps
            moved[1][place] -= eps
            up, down = (dataclasses.replace(model, **{name: x}) for x in moved)
            assert by[name][place] == pytest.approx((value(up) - value(down)) / (2 * eps), rel=1e-5, abs=1e-6), (name, place)


def test_prior_q_gives_the_prior_and_its_divergence_is_zero():
    data, model = toy()
    model = dataclasses.replace(model, mean=np.zeros(6), root=np.eye(6))
    _, mean, var, _ = model.project(data[:, :3], data[:, 3:-1], np.linalg.inv(model.factor()))
    assert model.divergence() == pytest.approx(0.0) and np.allclose(var, model.variance) and np.allclose(mean, model.beta[0] + data[:, 3:-1] @ model.beta[1:])


def test_marginals_are_those_of_the_dense_process():
    data, model = toy()
    k, _ = model.kernel(model.points, model.points)
    k = k + G.JITTER * model.variance * np.eye(len(k))
    cross, _ = model.kernel(data[:, :3], model.points)
    low = np.linalg.cholesky(k)
    mean_u, cov_u = low @ model.mean, low @ model.root @ model.root.T @ low.T
    w = cross @ np.linalg.inv(k)
    _, mean, var, _ = model.project(data[:, :3], data[:, 3:-1], np.linalg.inv(model.factor()))
    assert np.allclose(mean, model.beta[0] + data[:, 3:-1] @ model.beta[1:] + w @ mean_u)
    assert np.allclose(var, model.variance - (w * cross).sum(1) + ((w @ cov_u) * w).sum(1))


def test_natural_steps_climb_to_a_fixed_point():
    data, model = toy(200)
    model = dataclasses.replace(model, mean=np.zeros(6), root=np.eye(6))
    bounds = [bound(model, data)]
    for _ in range(60):
        model, used = G.natural_step(model, G.expected_likelihood(model, data), 1.0, 0.5)
        assert used == 0.5
        bounds.append(bound(model, data))
    assert bounds[-1] > bounds[0] and abs(bounds[-1] - bounds[-2]) < 1e-8
    by = G.carried(model, G.expected_likelihood(model, data))
    assert np.allclose(by["mean"] - model.mean, 0, atol=1e-5)


def test_ramp_and_backtracking():
    assert G.ramp(1, 0.01, 0.5, 20) == pytest.approx(0.01) and G.ramp(20, 0.01, 0.5, 20) == pytest.approx(0.5) and G.ramp(99, 0.01, 0.5, 20) == pytest.approx(0.5)
    assert G.ramp(2, 0.1, 0.4, 3) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        G.ramp(1, 0.5, 0.1, 2)
    data, model = toy()
    sums = G.expected_likelihood(model, data)
    sums["cov"] = 40 * np.eye(6)  # a target whose precision isn't positive
    _, used = G.natural_step(model, sums, 1.0, 1.0)
    assert used < 1.0
    sums["cov"] = np.full((6, 6), np.nan)
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        G.natural_step(model, sums, 1.0, 1.0)
    with pytest.raises(FloatingPointError):
        G.Adam(0.1)({"a": np.array([np.nan])})
    assert np.abs(G.Adam(0.1, clip=1.0)({"a": np.array([1e9])})["a"]).max() <= 0.1 + 1e-9


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 600
    x, y, t = rng.uniform(0, 6, n), rng.uniform(0, 6, n), rng.integers(0, 4, n)
    f = 1.5 * np.sin(x) + np.cos(y) + 0.2 * t
    z = rng.normal(size=n)
    label = (f + 0.8 * z + rng.normal(size=n) > 0.3).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(c), float(d), int(e)) for a, b, c, d, e in zip(x, y, t, z, label, strict=True)], "x double, y double, t int, z double, label int")


POINTS = np.array([[a, b, t] for a in (1, 3, 5) for b in (1, 3, 5) for t in (0, 2)], float)


@pytest.mark.parametrize("method", ["adam", "natgrad"])
def test_fit_raises_the_bound(rows, method, tmp_path):
    model = G.fit(rows, "x", "y", "t", ["z"], "label", POINTS, steps=14, method=method, rate=0.1, gamma=(0.1, 0.5, 5), settings={"space_x": 2.0, "space_y": 2.0, "time": 3.0})
    bounds = [h["bound"] for h in model.history]
    assert bounds[-1] > bounds[0] + 20 and model.beta[1] > 0.2 and len(bounds) == 14
    got = G.predict(rows, model, "x", "y", "t", ["z"], ["label"]).toPandas()
    loss = -np.mean(np.where(got.label == 1, np.log(got.p), np.log(1 - got.p)))
    assert loss < 0.66 and got.variance.gt(0).all()
    model.save(str(tmp_path / "m.npz"))
    again = G.Sparse.load(str(tmp_path / "m.npz"))
    assert again.state() == model.state() and np.array_equal(again.root, model.root)
    assert G.describe(model)["inducing_count"] == 18


def test_slices_freezing_and_faults(spark, rows):
    model = G.fit(rows, "x", "y", "t", ["z"], "label", POINTS, steps=4, slices=2, learn=("variance",), settings={"space_x": 2.0})
    assert (model.space_x, model.space_y, model.time) == (2.0, 1.0, 1.0) and model.variance != 1.0
    whole = bound(G.Sparse.start(POINTS, 1, space_x=2.0), rows.select("x", "y", "t", "z", "label").toPandas().to_numpy(float))
    assert model.history[0]["bound"] == pytest.approx(whole, rel=0.15)
    with pytest.raises(ValueError):
        G.fit(rows.withColumn("z", F.lit(None).cast("double")), "x", "y", "t", ["z"], "label", POINTS, steps=1)
    with pytest.raises(ValueError):
        G.fit(rows.limit(0), "x", "y", "t", ["z"], "label", POINTS, steps=1)
    with pytest.raises(ValueError):
        G.fit(rows, "x", "y", "t", ["z"], "label", POINTS, method="other")
    got = G.predict(spark.createDataFrame([(1.0, None, 1, 0.0)], "x double, y double, t int, z double"), model, "x", "y", "t", ["z"], ["x"]).first()
    assert got.x == 1.0 and got.p is None


def test_rolling_folds(rows):
    got = G.rolling(rows, "t", [0, 1, 2, 3], "x", "y", "t", ["z"], "label", POINTS, steps=2).groupBy("fold", "origin").count().collect()
    assert sorted((r.fold, r.origin) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_space_time_slopes_and_learning(rows):
    points = POINTS[::2, :2]
    given = dict(time="t", x="x", y="y", features=["z"], target="label", points=points, lengthscales=(2.0, 2.0), rounds=3)
    model = space_time.fit(rows, **given)
    data = space_time._rows(rows, "t", "x", "y", ["z"], "label")
    slopes = space_time.setting_slopes(data, model, space_time.LEARNT, 20)

    def plain(m):
        numbers = data.toPandas().to_numpy(float)
        total, inverse = m.log_prior, np.linalg.inv(m._kzz())
        for t in np.unique(numbers[:, 0]):
            part = numbers[numbers[:, 0] == t]
            _, mean, var = m.latent(part[:, 1:3], part[:, 3:-1], *m.at(t), inverse)
            total += expected_log_probit(part[:, -1], mean, var)[0].sum()
        return total

    now = space_time.settings_of(model)
    for name, slope in slopes.items():
        up, down = (plain(space_time.with_settings(model, {name: now[name] * np.exp(s * 1e-3)})) for s in (1, -1))
        assert slope == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-3), name
    learnt = space_time.fit(rows, **given, learn=("time", "variance"), learning_rate=0.2)
    assert learnt.lengthscales == (2.0, 2.0) and learnt.time_lengthscale != 1.5 and learnt.history[-1] > model.history[-1]
