"""A sparse Gaussian process over space and time for binary outcomes, fitted with Spark.

The latent value is a linear mean plus a separable Matern-3/2 process, carried by inducing points in
space and by their states over time. The posterior is the prior times one Gaussian site for each
time. A round is one pass over the rows: tasks add up the expected log likelihood's gradients into a
vector and a matrix for each time (inducing points squared, however many rows there are); the driver
turns the sums into new sites and a new mean and runs the block filter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import expected_log_probit, probit_probability
from ..operators.checkpoints import shared_path
from . import state_space as S
from .sparse_gp import Adam

JITTER = 1e-6


def inducing_points(df: DataFrame, x: str, y: str, k: int = 64, seed: int = 7) -> np.ndarray:
    """At most k centres of the distinct coordinates, by k-means."""
    places = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().distinct()
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(places).select("features")
    centres = np.array(KMeans(k=k, seed=seed, initMode="k-means||").fit(vectors).clusterCenters())
    return np.unique(centres, axis=0)


def inducing_grid(centres: np.ndarray, times) -> np.ndarray:
    """[times * centres, 3]: every centre at every distinct time, times together."""
    times = np.unique(np.asarray(times, float))
    return np.column_stack([np.tile(centres, (len(times), 1)), np.repeat(times, len(centres))])


def spatial_covariance(a: np.ndarray, b: np.ndarray, lengthscales) -> np.ndarray:
    """Matern-3/2 of unit variance, with a lengthscale for each direction."""
    scale = np.asarray(lengthscales, float)
    d = np.sqrt(3.0) * np.sqrt((((a[:, None, :] - b[None, :, :]) / scale) ** 2).sum(2))
    return (1 + d) * np.exp(-d)


@dataclass
class SpaceTime:
    """Kernel settings, mean weights (the intercept first), and the posterior at the training times."""

    points: np.ndarray
    times: np.ndarray
    lengthscales: tuple[float, float]
    time_lengthscale: float
    variance: float
    beta: np.ndarray
    site_vector: np.ndarray  # [T, M]
    site_matrix: np.ndarray  # [T, M, M]
    path: S.Path | None = None
    log_prior: float = 0.0
    history: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, points, times, n_features: int, lengthscales, time_lengthscale: float, variance: float) -> SpaceTime:
        """Sites that say almost nothing."""
        m, t = len(points), len(times)
        empty = cls(np.asarray(points, float), np.asarray(times, float), tuple(lengthscales), time_lengthscale, variance, np.zeros(n_features + 1), np.zeros((t, m)), np.tile(1e-6 * np.eye(m), (t, 1, 1)))
        return empty.solved()

    def _kzz(self) -> np.ndarray:
        return spatial_covariance(self.points, self.points, self.lengthscales) + JITTER * np.eye(len(self.points))

    def solved(self) -> SpaceTime:
        """With the states' posterior under the present sites. ``log_prior`` is what the sites cost:
        the evidence of the pseudo-observations less their expected log density."""
        m, eye, space = len(self.points), np.eye(len(self.points)), self._kzz()
        see = np.kron([[1.0, 0.0]], eye)
        moves = [(np.kron(a, eye), np.kron(q, space)) for a, q in S.moves_between(self.times, self.time_lengthscale, self.variance)]
        noises = [np.linalg.inv(p) for p in self.site_matrix]
        noises = [(n + n.T) / 2 for n in noises]
        values = [n @ v for n, v in zip(noises, self.site_vector, strict=True)]
        filtered = S.kalman(np.kron(S.stationary(self.time_lengthscale, self.variance), space), moves, see, values, noises)
        path = S.smooth(filtered)
        expected = 0.0
        for t in range(len(self.times)):
            gap = values[t] - path.means[t, :m]
            expected -= 0.5 * (gap @ self.site_matrix[t] @ gap + np.trace(self.site_matrix[t] @ path.covariances[t, :m, :m]) - np.linalg.slogdet(self.site_matrix[t])[1] + m * np.log(2 * np.pi))
        return replace(self, path=path, log_prior=filtered.log_marginal - expected)

    def at(self, time: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the inducing values at a training time or after the last one."""
        m = len(self.points)
        k = int(np.searchsorted(self.times, time))
        if k < len(self.times) and self.times[k] == time:
            return self.path.means[k, :m], self.path.covariances[k, :m, :m]
        if time < self.times[-1]:
            raise ValueError("a forecast must lie after the training times")
        step = time - self.times[-1]
        a = np.kron(S.transition(step, self.time_lengthscale), np.eye(m))
        cov = a @ self.path.covariances[-1] @ a.T + np.kron(S.process_noise(step, self.time_lengthscale, self.variance), self._kzz())
        return (a @ self.path.means[-1])[:m], cov[:m, :m]

    def latent(self, places: np.ndarray, features: np.ndarray, mean: np.ndarray, cov: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights on the inducing values, mean, variance) of rows at one time."""
        cross = spatial_covariance(places, self.points, self.lengthscales)
        w = cross @ inverse
        left = np.maximum(self.variance * (1 - (w * cross).sum(1)), 0)
        return w, self.beta[0] + features @ self.beta[1:] + w @ mean, np.maximum(((w @ cov) * w).sum(1) + left, 1e-9)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)


def _rows(df: DataFrame, time: str, x: str, y: str, features: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate((time, x, y, *features, *more))])


def _sums(rows: DataFrame, model: SpaceTime, degree: int) -> dict[float, np.ndarray]:
    """For each time: [log likelihood, M gradients, M x M curvatures, mean's gradient, mean's curvature]."""
    sent = rows.sparkSession.sparkContext.broadcast((model, np.linalg.inv(model._kzz())))  # inducing points and their states
    m, d = len(model.points), len(model.beta)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inverse = sent.value
        total: dict[float, np.ndarray] = {}
        for batch in batches:
            data = _columns(batch)
            for time in np.unique(data[:, 0]):
                part = data[data[:, 0] == time]
                w, mean, var = model.latent(part[:, 1:3], part[:, 3:-1], *model.at(time), inverse)
                value, g, h = expected_log_probit(part[:, -1], mean, var, degree)
                ones = np.column_stack([np.ones(len(part)), part[:, 3:-1]])
                got = np.concatenate([[value.sum()], w.T @ g, (-2 * (w.T * h) @ w).ravel(), ones.T @ g, (-2 * (ones.T * h) @ ones).ravel()])
                total[time] = total.get(time, 0.0) + got
        yield from packed(total)

    def packed(total: dict[float, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for time, got in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([time]), pa.array([got.tobytes()], pa.binary())], names=["time", "sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[float, np.ndarray] = {}
        for batch in batches:
            for time, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[time] = total.get(time, 0.0) + np.frombuffer(blob)
        yield from packed(total)

    parts = rows.mapInArrow(local, "time double, sums binary").repartition(len(model.times), "time").mapInArrow(joined, "time double, sums binary")
    out = {r.time: np.frombuffer(bytes(r.sums)) for r in parts.collect()}  # one row a training time
    blank = np.zeros(1 + m + m * m + d + d * d)
    return {t: out.get(t, blank) for t in model.times.tolist()}


def _bounds(rows: DataFrame, models: list[SpaceTime], degree: int) -> np.ndarray:
    """The bound of each of the models, from one pass over the rows."""
    sent = rows.sparkSession.sparkContext.broadcast([(m, np.linalg.inv(m._kzz())) for m in models])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value))
        for batch in batches:
            data = _columns(batch)
            for time in np.unique(data[:, 0]):
                part = data[data[:, 0] == time]
                for k, (model, inverse) in enumerate(sent.value):
                    _, mean, var = model.latent(part[:, 1:3], part[:, 3:-1], *model.at(time), inverse)
                    total[k] += expected_log_probit(part[:, -1], mean, var, degree)[0].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    got = rows.mapInArrow(local, "total array<double>").select(*[F.sum(F.col("total")[k]) for k in range(len(models))]).first()
    return np.array([v or 0.0 for v in got]) + np.array([m.log_prior for m in models])


#: Settings that a fit may learn, by logarithm.
LEARNT = ("space_x", "space_y", "time", "variance")


def settings_of(model: SpaceTime) -> dict[str, float]:
    return {"space_x": model.lengthscales[0], "space_y": model.lengthscales[1], "time": model.time_lengthscale, "variance": model.variance}


def with_settings(model: SpaceTime, values: dict[str, float]) -> SpaceTime:
    """The same sites and weights under other kernel settings, solved again."""
    new = settings_of(model) | values
    return replace(model, lengthscales=(new["space_x"], new["space_y"]), time_lengthscale=new["time"], variance=new["variance"]).solved()


def setting_slopes(rows: DataFrame, model: SpaceTime, learn: tuple[str, ...], degree: int, gap: float = 1e-4) -> dict[str, float]:
    """The bound's slopes by the logarithms of the settings, the sites held: central differences, all of
    them from one pass over the rows."""
    now = settings_of(model)
    tried = [with_settings(model, {k: now[k] * float(np.exp(sign * gap))}) for k in learn for sign in (1, -1)]
    got = _bounds(rows, tried, degree)
    return {k: float(got[2 * i] - got[2 * i + 1]) / (2 * gap) for i, k in enumerate(learn)}


def fit(df: DataFrame, time: str, x: str, y: str, features: list[str], target: str, points: np.ndarray, lengthscales=(5.0, 5.0), time_lengthscale: float = 1.5, variance: float = 1.0, rounds: int = 12, gamma: float = 0.5, ridge: float = 1e-3, degree: int = 20, learn: tuple[str, ...] = (), learning_rate: float = 0.05, clip: float = 10.0) -> SpaceTime:
    """Natural-gradient rounds over all rows; ``history`` has the bound before each and after the last.

    Sites move by the share ``gamma`` towards their targets; the mean takes a Newton step of the same
    share with a small ridge. The probit likelihood is log-concave, so site matrices stay positive.
    After the sites the settings in ``learn`` (see LEARNT) take an Adam step of ``learning_rate`` by the
    bound's slopes, whose length is held to ``clip``; the others are frozen. Rows with a null in a needed
    column raise; times are the distinct values, which are few.
    """
    rows = _rows(df, time, x, y, features, target)
    path = f"{shared_path(df.sparkSession)}/space-time-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # every round reads the needed numbers, not the source
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    nulls, times = rows.agg(F.count_if(F.concat_ws("", *[F.col(c).isNull().cast("string") for c in rows.columns]).contains("true")), F.sort_array(F.collect_set("c0"))).first()
    if nulls or not times:
        raise ValueError(f"{nulls} rows have a null" if nulls else "no rows")
    model = SpaceTime.start(points, times, len(features), lengthscales, time_lengthscale, variance)
    m, d = len(points), len(features) + 1
    history, adam = [], Adam(learning_rate, clip)
    for step in range(rounds + 1):
        sums = _sums(rows, model, degree)
        history.append(sum(v[0] for v in sums.values()) + model.log_prior)
        if step == rounds:
            break
        vector, matrix = np.empty_like(model.site_vector), np.empty_like(model.site_matrix)
        slope, curve = -ridge * model.beta, ridge * np.eye(d)
        for t, got in enumerate(sums.values()):
            gradient, curvature = got[1 : 1 + m], got[1 + m : 1 + m + m * m].reshape(m, m)
            vector[t] = gradient + curvature @ model.path.means[t, :m]
            matrix[t] = (curvature + curvature.T) / 2 + 1e-6 * np.eye(m)
            slope = slope + got[1 + m + m * m : 1 + m + m * m + d]
            curve = curve + got[1 + m + m * m + d :].reshape(d, d)
        model = replace(
            model,
            beta=model.beta + gamma * np.linalg.solve(curve, slope),
            site_vector=(1 - gamma) * model.site_vector + gamma * vector,
            site_matrix=(1 - gamma) * model.site_matrix + gamma * matrix,
        ).solved()
        if learn:
            moves = adam({k: np.array([v]) for k, v in setting_slopes(rows, model, learn, degree).items()})
            now = settings_of(model)
            model = with_settings(model, {k: now[k] * float(np.exp(v[0])) for k, v in moves.items()})
    return replace(model, history=history)


def tune(df: DataFrame, settings: list[dict], **given) -> SpaceTime:
    """The fit with the largest bound among kernel settings (lengthscales, time_lengthscale, variance)."""
    return max((fit(df, **given, **s) for s in settings), key=lambda m: m.history[-1])


def predict(df: DataFrame, model: SpaceTime, time: str, x: str, y: str, features: list[str], keep: list[str]) -> DataFrame:
    """keep, mean, variance, p of every row, at training times or after the last; earlier or unknown times raise.

    Rows with a null input get nulls.
    """
    sent = df.sparkSession.sparkContext.broadcast((model, np.linalg.inv(model._kzz())))
    inputs = [time, x, y, *features]
    picked = df.select(*keep, *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(inputs)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inverse = sent.value
        for batch in batches:
            data = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n, batch.num_columns)])
            out = np.full((len(data), 3), np.nan)
            whole = ~np.isnan(data).any(1)
            for at in np.unique(data[whole, 0]):
                here = np.flatnonzero(whole & (data[:, 0] == at))
                _, mean, var = model.latent(data[here, 1:3], data[here, 3:], *model.at(at), inverse)
                out[here] = np.column_stack([mean, var, probit_probability(mean, var)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, mask=np.isnan(c)) for c in out.T]], names=[*batch.schema.names[:n], "mean", "variance", "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n]) + ", mean double, variance double, p double"
    return picked.mapInArrow(run, schema)
