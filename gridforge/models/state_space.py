"""Matern-3/2 processes in state space: kernels, filter, smoother, and smoothing of many series.

The state is the function and its slope. ``kalman`` and ``smooth`` take any state and observation
matrices, so one series (two states) and a grid of inducing points (two states for each) share them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(lengthscale: float) -> float:
    return np.sqrt(3.0) / lengthscale


def covariance(a, b, lengthscale: float, variance: float) -> np.ndarray:
    """Kernel matrix between two lists of times."""
    d = rate(lengthscale) * np.abs(np.subtract.outer(np.asarray(a, float), np.asarray(b, float)))
    return variance * (1 + d) * np.exp(-d)


def covariance_column(a: Column, b: Column, lengthscale: float, variance: float) -> Column:
    """The kernel of two columns of times, as an expression."""
    d = F.abs(a - b) * F.lit(float(rate(lengthscale)))
    return F.lit(float(variance)) * (F.lit(1.0) + d) * F.exp(-d)


def continuous_matrices(lengthscale: float, variance: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Drift, noise's entry, its density and the observation of the process in continuous time."""
    r = rate(lengthscale)
    return np.array([[0.0, 1.0], [-r * r, -2 * r]]), np.array([[0.0], [1.0]]), 4 * r**3 * variance, np.array([[1.0, 0.0]])


def stationary(lengthscale: float, variance: float) -> np.ndarray:
    return np.diag([variance, variance * rate(lengthscale) ** 2])


def transition(step: float, lengthscale: float) -> np.ndarray:
    r = rate(lengthscale)
    return np.exp(-r * step) * np.array([[1 + r * step, step], [-r * r * step, 1 - r * step]])


def process_noise(step: float, lengthscale: float, variance: float) -> np.ndarray:
    """What the stationary state gains over a step, so that it stays stationary."""
    a, p = transition(step, lengthscale), stationary(lengthscale, variance)
    return p - a @ p @ a.T


@dataclass
class Path:
    """State means and covariances by time; ``moves`` leads from each time to the next."""

    means: np.ndarray
    covariances: np.ndarray
    moves: list[tuple[np.ndarray, np.ndarray]]
    log_marginal: float


def kalman(start: np.ndarray, moves, observe: np.ndarray, values, noises) -> Path:
    """Filter from a zero mean and covariance ``start``. ``moves`` are (transition, noise) between
    neighbouring times; ``values[t]`` is observed as ``observe @ state`` with covariance ``noises[t]``,
    or is None where nothing was seen. Updates keep covariances symmetric and positive."""
    size = len(start)
    mean, cov, total = np.zeros(size), start, 0.0
    means, covs = [], []
    for t, (value, noise) in enumerate(zip(values, noises, strict=True)):
        if t:
            a, q = moves[t - 1]
            mean, cov = a @ mean, a @ cov @ a.T + q
        if value is not None:
            seen = observe @ cov @ observe.T + noise
            gap = np.atleast_1d(value) - observe @ mean
            gain = np.linalg.solve(seen, observe @ cov).T
            rest = np.eye(size) - gain @ observe
            mean, cov = mean + gain @ gap, rest @ cov @ rest.T + gain @ noise @ gain.T
            total -= 0.5 * (gap @ np.linalg.solve(seen, gap) + np.linalg.slogdet(seen)[1] + len(gap) * np.log(2 * np.pi))
        cov = (cov + cov.T) / 2
        means.append(mean)
        covs.append(cov)
    return Path(np.array(means), np.array(covs), list(moves), float(total))


def smooth(path: Path) -> Path:
    """Means and covariances given all times, backwards from the filter's."""
    means, covs = path.means.copy(), path.covariances.copy()
    for t in range(len(means) - 2, -1, -1):
        a, q = path.moves[t]
        ahead = a @ path.covariances[t] @ a.T + q
        back = np.linalg.solve(ahead, a @ path.covariances[t]).T
        means[t] += back @ (means[t + 1] - a @ path.means[t])
        covs[t] += back @ (covs[t + 1] - ahead) @ back.T
        covs[t] = (covs[t] + covs[t].T) / 2
    return Path(means, covs, path.moves, path.log_marginal)


def moves_between(times, lengthscale: float, variance: float) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(transition(d, lengthscale), process_noise(d, lengthscale, variance)) for d in np.diff(np.asarray(times, float))]


def smooth_one(times, values, noises, lengthscale: float, variance: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, variances, log marginal) of one series with scalar observations at increasing times."""
    filtered = kalman(stationary(lengthscale, variance), moves_between(times, lengthscale, variance), np.array([[1.0, 0.0]]), list(values), [np.array([[n]]) for n in noises])
    out = smooth(filtered)
    return out.means[:, 0], out.covariances[:, 0, 0], filtered.log_marginal


def smooth_stack(times, values: np.ndarray, noises: np.ndarray, lengthscale: float, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """[series, times] means and variances of many series with the same times, filtered and smoothed side by side."""
    moves = moves_between(times, lengthscale, variance)
    mean, cov = np.zeros((len(values), 2)), np.tile(stationary(lengthscale, variance), (len(values), 1, 1))
    means, covs = [], []
    for t in range(values.shape[1]):
        if t:
            a, q = moves[t - 1]
            mean, cov = mean @ a.T, a @ cov @ a.T + q
        gain = cov[:, :, 0] / (cov[:, 0, 0] + noises[:, t])[:, None]
        mean = mean + gain * (values[:, t] - mean[:, 0])[:, None]
        rest = np.tile(np.eye(2), (len(values), 1, 1))
        rest[:, :, 0] -= gain
        cov = rest @ cov @ rest.transpose(0, 2, 1) + noises[:, t, None, None] * gain[:, :, None] * gain[:, None, :]
        means.append(mean)
        covs.append(cov)
    for t in range(len(means) - 2, -1, -1):
        a, q = moves[t]
        ahead = a @ covs[t] @ a.T + q
        back = np.linalg.solve(ahead, a @ covs[t]).transpose(0, 2, 1)
        gap = means[t + 1] - means[t] @ a.T
        means[t] = means[t] + (back @ gap[:, :, None])[:, :, 0]
        covs[t] = covs[t] + back @ (covs[t + 1] - ahead) @ back.transpose(0, 2, 1)
    return np.stack([m[:, 0] for m in means], 1), np.stack([c[:, 0, 0] for c in covs], 1)


def smooth_series(df: DataFrame, keys: list[str], time: str, value: str, noise: float, lengthscale: float, variance: float) -> DataFrame:
    """keys, time, n, mean, variance: each key's series given all its observations.

    Observations of one key and time are first added up (n of them with noise s2 say the same as
    their mean with s2 / n), so a hot key's rows combine before the shuffle, and a task holds a
    key's distinct times only. The series of a batch that have the same times are worked off side by
    side. Null times or values are passed over; an empty table gives an empty result.
    """
    seen = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.col(time).cast("double").alias(time)).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "n", "mean"))).alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            edge = column.offsets.to_numpy().astype(np.int64)
            at, n, mean = (column.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            size = np.diff(edge)
            out = np.empty((2, edge[-1]))
            alike: dict[bytes, list[int]] = {}
            for k in range(batch.num_rows):
                alike.setdefault(at[edge[k] : edge[k + 1]].tobytes(), []).append(k)
            for series in alike.values():
                place = edge[series][:, None] + np.arange(size[series[0]])
                out[0, place], out[1, place] = smooth_stack(at[place[0]], mean[place], noise / n[place], lengthscale, variance)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), size))
            inside = slice(edge[0], edge[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(len(keys))), pa.array(at[inside]), pa.array(n[inside]), *(pa.array(x[inside]) for x in out)], names=[*keys, time, "n", "mean", "variance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema.fields) + ", variance double"
    return rows.mapInArrow(run, schema)
