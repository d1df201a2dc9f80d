"""Labels over time: Matern-3/2 processes seen through a probit likelihood, by conjugate computations.

Each time has a Gaussian site in natural parameters; it stands for an observation, so the posterior
under the sites is that of a filter and smoother. Sites move by a share of their natural parameters
towards the likelihood's gradients by the moments. Series of a batch with the same times are worked off
side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import expected_log_probit, probit_probability
from . import state_space as S


@dataclass
class Sites:
    """Natural parameters, [series, times]: vector and precision."""

    vector: np.ndarray
    precision: np.ndarray

    @classmethod
    def start(cls, series: int, times: int, precision: float = 1e-3) -> Sites:
        if precision <= 0:
            raise ValueError("a precision must be positive")
        return cls(np.zeros((series, times)), np.full((series, times), precision))

    def observations(self) -> tuple[np.ndarray, np.ndarray]:
        """The values and noise variances that the sites stand for."""
        return self.vector / self.precision, 1 / self.precision


def likelihood(ones: np.ndarray, zeros: np.ndarray, mean: np.ndarray, var: np.ndarray, degree: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected log likelihood of so many labels 1 and 0 at each time, with its slopes by mean and variance."""
    shape = mean.shape
    up, down = (expected_log_probit(np.full(mean.size, y), mean.ravel(), var.ravel(), degree) for y in (1.0, 0.0))
    return tuple((ones * a.reshape(shape) + zeros * b.reshape(shape)) for a, b in zip(up, down, strict=True))


def moment_gradients(mean: np.ndarray, by_mean: np.ndarray, by_var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes by the first and second moment."""
    return by_mean - 2 * by_var * mean, by_var


def moved(sites: Sites, gradients: tuple[np.ndarray, np.ndarray], gamma: float, least: float = 1e-9) -> Sites:
    """Sites a share ``gamma`` of the way to the gradients; the probit is log-concave, so precisions stay positive."""
    vector = (1 - gamma) * sites.vector + gamma * gradients[0]
    return Sites(vector, np.maximum((1 - gamma) * sites.precision - 2 * gamma * gradients[1], least))


def bound(times, sites: Sites, ones, zeros, lengthscale: float, variance: float, degree: int = 20) -> np.ndarray:
    """The evidence bound of each series: likelihood, less the sites' expected density, plus their evidence."""
    values, noises = sites.observations()
    mean, var = S.smooth_stack(times, values, noises, lengthscale, variance)
    expected = -0.5 * (np.log(2 * np.pi * noises) + ((values - mean) ** 2 + var) / noises)
    evidence = np.array([S.smooth_one(times, v, n, lengthscale, variance)[2] for v, n in zip(values, noises, strict=True)])
    return (likelihood(ones, zeros, mean, var, degree)[0] - expected).sum(1) + evidence


def fit(times, ones: np.ndarray, zeros: np.ndarray, lengthscale: float, variance: float, gamma: float = 0.5, rounds: int = 25, degree: int = 20, precision: float = 1e-3) -> tuple[Sites, np.ndarray, np.ndarray]:
    """(sites, means, variances) after the rounds, of [series, times] counts of labels."""
    sites = Sites.start(*ones.shape, precision)
    for _ in range(rounds):
        mean, var = S.smooth_stack(times, *sites.observations(), lengthscale, variance)
        _, by_mean, by_var = likelihood(ones, zeros, mean, var, degree)
        sites = moved(sites, moment_gradients(mean, by_mean, by_var), gamma)
    return sites, *S.smooth_stack(times, *sites.observations(), lengthscale, variance)


def smooth_labels(df: DataFrame, keys: list[str], time: str, label: str, lengthscale: float, variance: float, gamma: float = 0.5, rounds: int = 25) -> DataFrame:
    """keys, time, ones, zeros, mean, variance, p of each key and time that has labels.

    Labels of one key and time are counted before the shuffle, so a task holds a key's distinct times
    only. Null times and labels are passed over, labels beside 0 and 1 raise; an empty table gives an
    empty result.
    """
    value = F.col(label)
    checked = F.when(value.isin(0, 1), value).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int"))
    seen = df.filter(F.col(time).isNotNull() & value.isNotNull()).groupBy(*keys, F.col(time).cast("double").alias(time)).agg(F.sum(checked).cast("double").alias("ones"), F.count("*").cast("double").alias("n"))
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "ones", "n"))).alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            edge = column.offsets.to_numpy().astype(np.int64)
            at, ones, n = (column.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            size = np.diff(edge)
            out = np.empty((3, edge[-1]))
            alike: dict[bytes, list[int]] = {}
            for k in range(batch.num_rows):
                alike.setdefault(at[edge[k] : edge[k + 1]].tobytes(), []).append(k)
            for series in alike.values():
                place = edge[series][:, None] + np.arange(size[series[0]])
                _, out[0, place], out[1, place] = fit(at[place[0]], ones[place], n[place] - ones[place], lengthscale, variance, gamma, rounds)
            out[2] = probit_probability(out[0], out[1])
            owner = pa.array(np.repeat(np.arange(batch.num_rows), size))
            inside = slice(edge[0], edge[-1])
            count = [pa.array(x[inside].astype(np.int64)) for x in (ones, n - ones)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(len(keys))), pa.array(at[inside]), *count, *(pa.array(x[inside]) for x in out)], names=[*keys, time, "ones", "zeros", "mean", "variance", "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema.fields[:-2]) + ", ones long, zeros long, mean double, variance double, p double"
    return rows.mapInArrow(run, schema)
