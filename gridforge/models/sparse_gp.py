"""Sparse variational Gaussian process for 0/1 labels over space and time, fitted by gradients.

f = beta0 + x . beta + g, g with a separable Matern kernel of space and time, P(y = 1) = Phi(f). The
values at fixed inducing points are u = chol(K) v, and q(v) is a full Gaussian. A step is one pass over
one slice of the rows, which adds up, in a task at a time, the likelihood with its derivatives by q, by
the mean's weights and by the rows' covariances; the driver carries them on to the kernel's settings
through the Cholesky factor. Sums have the size of the inducing points squared, never of the rows.

Slices are written once, apart by a hash of the row, so a step reads its own slice alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import expected_log_probit, probit_probability
from ..operators.checkpoints import shared_path

JITTER = 1e-6
#: Settings that a fit may learn, all positive and learnt as logarithms.
LEARNT = ("space_x", "space_y", "time", "variance")


@dataclass
class Sparse:
    """Kernel settings, the mean's weights (the intercept first), points (x, y, time) and q(v) = N(mean, root root')."""

    points: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    root: np.ndarray
    space_x: float = 1.0
    space_y: float = 1.0
    time: float = 1.0
    variance: float = 1.0
    family: str = "matern32"
    history: list[dict] = field(default_factory=list)

    @classmethod
    def start(cls, points, n_features: int, **settings) -> Sparse:
        points = np.asarray(points, float)
        return cls(points, np.zeros(n_features + 1), np.zeros(len(points)), np.eye(len(points)), **settings)

    def kernel(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Covariances and their derivatives by the logarithm of each setting. The time's factor may be
        of the rougher family (``matern12``)."""
        scale = np.array([self.space_x, self.space_y])
        gap = ((a[:, None, :2] - b[None, :, :2]) / scale) ** 2
        r = np.sqrt(3 * gap.sum(2))
        space = (1 + r) * np.exp(-r)
        by_gap = 3 * np.exp(-r)  # minus twice the derivative by the squared distance
        lag = np.abs(a[:, None, 2] - b[None, :, 2]) / self.time
        if self.family == "matern32":
            s = np.sqrt(3) * lag
            along, along_log = (1 + s) * np.exp(-s), s * s * np.exp(-s)
        elif self.family == "matern12":
            along, along_log = np.exp(-lag), lag * np.exp(-lag)
        else:
            raise ValueError("family must be 'matern32' or 'matern12'")
        k = self.variance * space * along
        slopes = {"space_x": self.variance * along * by_gap * gap[:, :, 0], "space_y": self.variance * along * by_gap * gap[:, :, 1], "time": self.variance * space * along_log, "variance": k}
        return k, slopes

    def factor(self) -> np.ndarray:
        k, _ = self.kernel(self.points, self.points)
        return np.linalg.cholesky(k + JITTER * self.variance * np.eye(len(k)))

    def project(self, places: np.ndarray, features: np.ndarray, inverse: np.ndarray):
        """(A, mean, variance, slopes) of rows; A are the weights on v, slopes those of the covariances."""
        cross, slopes = self.kernel(places, self.points)
        a = cross @ inverse.T
        spread = a @ self.root
        var = self.variance - (a * a).sum(1) + (spread * spread).sum(1)
        return a, self.beta[0] + features @ self.beta[1:] + a @ self.mean, np.maximum(var, 1e-9), slopes

    def divergence(self) -> float:
        """KL of q(v) from the standard normal."""
        m = len(self.mean)
        return 0.5 * float((self.root**2).sum() + self.mean @ self.mean - m) - float(np.log(np.abs(np.diag(self.root))).sum())

    def state(self) -> dict:
        """The settings and weights as plain values."""
        return {**{k: float(getattr(self, k)) for k in LEARNT}, "family": self.family, "intercept": float(self.beta[0]), "coefficients": self.beta[1:].tolist(), "inducing_count": len(self.points)}

    def save(self, path: str) -> None:
        """All that prediction needs, as one file of arrays."""
        with open(path, "wb") as file:
            np.savez(file, points=self.points, beta=self.beta, mean=self.mean, root=self.root, settings=np.array([getattr(self, k) for k in LEARNT]), family=np.array(self.family))

    @classmethod
    def load(cls, path: str) -> Sparse:
        with np.load(path) as got:
            return cls(got["points"], got["beta"], got["mean"], got["root"], *got["settings"].tolist(), str(got["family"]))


def expected_likelihood(model: Sparse, data: np.ndarray, degree: int = 20) -> dict[str, np.ndarray]:
    """Sums over rows (x, y, time, features, label) of the expected log likelihood and of its derivatives:
    by mean and covariance of q, by the weights, by A (as a matrix) and by the settings through the rows'
    own covariances."""
    factor = model.factor()
    inverse = np.linalg.inv(factor)
    places, features, y = data[:, :3], data[:, 3:-1], data[:, -1]
    a, mean, var, slopes = model.project(places, features, inverse)
    value, g, h = expected_log_probit(y, mean, var, degree)
    cov = model.root @ model.root.T
    by_a = g[:, None] * model.mean + 2 * h[:, None] * (a @ (cov - np.eye(len(cov))))
    by_cross = by_a @ inverse  # derivative by the rows' covariances with the points
    own = np.array([(by_cross * slopes[k]).sum() + (model.variance * h.sum() if k == "variance" else 0.0) for k in LEARNT])
    ones = np.column_stack([np.ones(len(y)), features])
    return {"value": np.array([value.sum()]), "mean": a.T @ g, "cov": (a.T * h) @ a, "beta": ones.T @ g, "spread": by_a.T @ a, "own": own, "rows": np.array([float(len(y))])}


def carried(model: Sparse, sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Derivatives of the likelihood by mean, root, weights and log settings."""
    factor = model.factor()
    inverse = np.linalg.inv(factor)
    by_factor = np.tril(-inverse.T @ sums["spread"])
    inner = np.tril(factor.T @ by_factor)
    np.fill_diagonal(inner, np.diag(inner) / 2)
    by_k = inverse.T @ inner @ inverse
    by_k = (by_k + by_k.T) / 2
    k, slopes = model.kernel(model.points, model.points)
    eye = JITTER * model.variance * np.eye(len(k))
    settings = np.array([(by_k * (slopes[s] + (eye if s == "variance" else 0))).sum() for s in LEARNT]) + sums["own"]
    return {"mean": sums["mean"], "root": np.tril(2 * sums["cov"] @ model.root), "beta": sums["beta"], "settings": settings}


def ramp(step: int, first: float, last: float, steps: int) -> float:
    """The natural gradient's share at a step from 1 on: from first to last along a log-linear ramp."""
    if not 0 < first <= last or steps < 1:
        raise ValueError("shares must be positive and not fall, steps at least 1")
    return float(np.exp(np.log(first) + min(max((step - 1) / max(steps - 1, 1), 0.0), 1.0) * (np.log(last) - np.log(first))))


def natural_step(model: Sparse, sums: dict[str, np.ndarray], scale: float, gamma: float, least: float = 1e-6) -> tuple[Sparse, float]:
    """q moved by the share ``gamma`` of its natural parameters towards the target that these rows give;
    halved, on the same sums, where the new precision isn't positive. (model, share used)."""
    m = len(model.mean)
    precision = np.linalg.inv(model.root @ model.root.T)
    target_vector = scale * (sums["mean"] - 2 * sums["cov"] @ model.mean)
    target_matrix = np.eye(m) - 2 * scale * sums["cov"]
    while gamma >= least:
        matrix = (1 - gamma) * precision + gamma * target_matrix
        vector = (1 - gamma) * precision @ model.mean + gamma * target_vector
        try:
            low = np.linalg.cholesky((matrix + matrix.T) / 2)
            cov = np.linalg.inv(low).T @ np.linalg.inv(low)
            moved = replace(model, mean=cov @ vector, root=np.linalg.cholesky((cov + cov.T) / 2))
            if np.isfinite(moved.mean).all():
                return moved, gamma
        except np.linalg.LinAlgError:
            pass
        gamma /= 2
    raise RuntimeError("the natural gradient stays unstable on these rows")


class Adam:
    """Steps upwards; the joint gradient's length is held to ``clip``."""

    def __init__(self, rate: float, clip: float = np.inf):
        self.rate, self.clip, self.t = rate, clip, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def __call__(self, gradients: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.t += 1
        length = float(np.sqrt(sum((g**2).sum() for g in gradients.values())))
        if not np.isfinite(length):
            raise FloatingPointError("a gradient is not finite")
        out = {}
        for k, g in gradients.items():
            g = g * min(1.0, self.clip / max(length, 1e-300))
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            out[k] = self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return out


def _sliced(df: DataFrame, columns: list[str], slices: int) -> tuple[DataFrame, int]:
    """The rows as numbers in the shared folder, apart by slice; (frame with slice, rows). Nulls raise."""
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    null = F.coalesce(*[F.when(F.col(c).isNull() | F.isnan(c), 1) for c in rows.columns], F.lit(0)) == 1
    path = f"{shared_path(df.sparkSession)}/sparse-gp-{uuid.uuid4().hex}"
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(slices)).cast("int"))
    rows.write.partitionBy("slice").parquet(path)
    saved = df.sparkSession.read.schema(rows.schema).parquet(path)
    n, bad = saved.agg(F.count("*"), F.count_if(null)).first()
    if bad or not n:
        raise ValueError(f"{bad} rows have a null" if bad else "no rows")
    return saved, n


def _sums(rows: DataFrame, model: Sparse, degree: int) -> dict[str, np.ndarray]:
    """expected_likelihood() of all rows: added up in each task, then over the tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # inducing points squared numbers
    blank = expected_likelihood(model, np.zeros((0, len(rows.columns) - 1)), degree)
    sizes = {k: v.shape for k, v in blank.items()}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for low in range(0, len(data), 4096):
                got = np.concatenate([v.ravel() for v in expected_likelihood(sent.value, data[low : low + 4096], degree).values()])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b) for batch in batches for b in batch.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], names=["sums"])

    parts = rows.drop("slice").mapInArrow(local, "sums binary")
    rows_ = parts.repartition(8).mapInArrow(joined, "sums binary").collect()  # eight rows at most
    flat = sum((np.frombuffer(bytes(r.sums)) for r in rows_), np.zeros(sum(int(np.prod(s)) for s in sizes.values())))
    sent.unpersist()
    out, at = {}, 0
    for k, s in sizes.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def fit(df: DataFrame, x: str, y: str, time: str, features: list[str], target: str, points: np.ndarray, steps: int = 100, slices: int = 1, method: str = "adam", rate: float = 0.05, clip: float = np.inf, learn: tuple[str, ...] = LEARNT, gamma: tuple[float, float, int] = (0.01, 0.5, 20), degree: int = 20, settings: dict | None = None) -> Sparse:
    """``steps`` steps over the slices in turn. ``adam`` moves q, the weights and the settings together;
    ``natgrad`` moves q by the natural gradient, with the ramp gamma = (first, last, steps), after an Adam
    step of the rest on the same rows. Settings that aren't in ``learn`` stay. ``history`` has for each step
    the estimate of the bound before it and the share used. Rows with a null raise."""
    if method not in ("adam", "natgrad"):
        raise ValueError("method must be 'adam' or 'natgrad'")
    rows, n = _sliced(df, [x, y, time, *features, target], slices)
    model, adam, history = Sparse.start(points, len(features), **(settings or {})), Adam(rate, clip), []
    open_ = np.array([k in learn for k in LEARNT], float)
    for step in range(1, steps + 1):
        part = rows if slices == 1 else rows.filter(F.col("slice") == (step - 1) % slices)
        sums = _sums(part, model, degree)
        if not sums["rows"][0]:
            continue
        scale = n / float(sums["rows"][0])
        bound = scale * float(sums["value"][0]) - model.divergence()
        by = {k: scale * v for k, v in carried(model, sums).items()}
        by["settings"] = by["settings"] * open_
        used = 0.0
        if method == "adam":
            by["mean"] = by["mean"] - model.mean
            by["root"] = by["root"] - np.tril(model.root) + np.diag(1 / np.diag(model.root))
        else:
            by = {k: by[k] for k in ("beta", "settings")}
        moves = adam(by)
        log = np.log([getattr(model, k) for k in LEARNT]) + moves["settings"]
        changed = replace(model, beta=model.beta + moves["beta"], **dict(zip(LEARNT, np.exp(log).tolist(), strict=True)))
        if method == "adam":
            changed = replace(changed, mean=model.mean + moves["mean"], root=np.tril(model.root + moves["root"]))
        else:
            changed, used = natural_step(changed, sums, scale, ramp(step, *gamma))
        history.append({"step": step, "bound": bound, "gamma": used})
        model = changed
    return replace(model, history=history)


def predict(df: DataFrame, model: Sparse, x: str, y: str, time: str, features: list[str], keep: list[str]) -> DataFrame:
    """keep, mean, variance, p of every row, in Arrow batches; a row with a null input gets nulls."""
    sent = df.sparkSession.sparkContext.broadcast((model, np.linalg.inv(model.factor())))
    picked = df.select(*keep, *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate([x, y, time, *features])])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inverse = sent.value
        for batch in batches:
            data = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n, batch.num_columns)])
            out = np.full((len(data), 3), np.nan)
            whole = np.flatnonzero(~np.isnan(data).any(1))
            for low in range(0, len(whole), 4096):
                at = whole[low : low + 4096]
                _, mean, var, _ = model.project(data[at, :3], data[at, 3:], inverse)
                out[at] = np.column_stack([mean, var, probit_probability(mean, var)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, mask=np.isnan(c)) for c in out.T]], names=[*batch.schema.names[:n], "mean", "variance", "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n]) + ", mean double, variance double, p double"
    return picked.mapInArrow(run, schema)


def rolling(df: DataFrame, origin: str, origins: list[int], x: str, y: str, time: str, features: list[str], target: str, points: np.ndarray, keep: tuple[str, ...] = (), **given) -> DataFrame:
    """fold, origin, kept columns, y, mean, variance, p: each origin forecast by a fit of all earlier ones."""
    out = None
    for fold, at in enumerate(sorted(origins)[1:], 1):
        model = fit(df.filter(F.col(origin) < at), x, y, time, features, target, points, **given)
        scored = predict(df.filter(F.col(origin) == at), model, x, y, time, features, [*keep, origin, target])
        scored = scored.withColumnsRenamed({origin: "origin", target: "y"}).withColumn("fold", F.lit(fold))
        out = scored if out is None else out.unionByName(scored)
    return out


def compare_feature_sets(df: DataFrame, sets: dict[str, list[str]], scorer) -> DataFrame:
    """scorer(df, features) for each named set, one under the other with the set's name."""
    out = None
    for name, features in sets.items():
        got = scorer(df, features).withColumn("feature_set", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def describe(model: Sparse) -> dict:
    """The state with its history's last bound, for a model card."""
    return {**model.state(), "bound": model.history[-1]["bound"] if model.history else None, "settings": {k: v for k, v in asdict(model).items() if k in LEARNT}}
