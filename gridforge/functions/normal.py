"""The normal distribution function for whole arrays and columns, and expectations under a normal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 3.0


def log_cdf(z) -> np.ndarray:
    """log Phi(z): a power series near 0, and the tail's continued fraction beyond."""
    z = np.asarray(z, float)
    a = np.abs(z)
    log_density = -0.5 * z * z - 0.5 * np.log(2 * np.pi)
    near = np.minimum(a, NEAR)
    term = total = near
    for k in range(1, 60):
        term = term * near * near / (2 * k + 1)
        total = total + term
    half = np.exp(-0.5 * near * near) / np.sqrt(2 * np.pi) * total
    far = np.maximum(a, NEAR)
    ratio = far
    for k in range(120, 0, -1):
        ratio = far + k / ratio
    tail = log_density - np.log(ratio)  # log Phi(-a) where a is far
    low = np.where(a <= NEAR, np.log(0.5 - half), tail)
    high = np.where(a <= NEAR, np.log(0.5 + half), np.log1p(-np.exp(np.minimum(tail, -1e-300))))
    return np.where(z < 0, low, high)


def cdf(z) -> np.ndarray:
    return np.exp(log_cdf(z))


def cdf_column(z: Column) -> Column:
    """Phi of a column, in Arrow batches. NULL stays NULL."""

    @F.pandas_udf("double")
    def phi(values: pd.Series) -> pd.Series:
        return pd.Series(cdf(values.to_numpy(float))).where(values.notna(), None)

    return phi(z.cast("double"))


def probit_probability(mean, variance) -> np.ndarray:
    """P(y = 1) when the latent value is normal: Phi(m / sqrt(1 + v))."""
    return cdf(np.asarray(mean) / np.sqrt(1 + np.asarray(variance)))


def expected_log_probit(y, mean, variance, degree: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E[log Phi(s f)] for f ~ N(mean, variance), s = 2y - 1, by Gauss-Hermite quadrature, with its
    derivatives by the mean and by the variance."""
    nodes, weights = np.polynomial.hermite.hermgauss(degree)
    weights = weights / np.sqrt(np.pi)
    sign = 2.0 * np.asarray(y, float)[:, None] - 1
    z = sign * (np.asarray(mean, float)[:, None] + np.sqrt(2 * np.asarray(variance, float))[:, None] * nodes)
    value = log_cdf(z)
    slope = np.exp(-0.5 * z * z - 0.5 * np.log(2 * np.pi) - value)  # density over distribution
    return value @ weights, (sign * slope) @ weights, -0.5 * (slope * (z + slope)) @ weights
