"""L2 logistic regression over rolling folds, fitted by Newton steps on standardised features.

All folds are fitted together: a step is one pass over the rows, in which a task adds up each fold's
gradient and curvature (features squared numbers) from the rows that the fold may see.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


@dataclass
class Logistic:
    """Coefficients on standardised features; a few numbers, so scoring is one JVM expression."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    rows: int
    prevalence: float

    def score(self, df: DataFrame) -> DataFrame:
        """Adds p. A row with a null feature gets a null p."""
        total = F.lit(self.intercept)
        for name, mean, scale, weight in zip(self.features, self.means, self.scales, self.weights, strict=True):
            total = total + (F.col(name) - mean) / scale * weight
        return df.withColumn("p", 1 / (1 + F.exp(-total)))

    def odds(self) -> list[tuple[str, float, float]]:
        """(feature, coefficient, odds ratio of one deviation)."""
        return [(n, w, math.exp(w)) for n, w in zip(self.features, self.weights, strict=True)]


def _checked(rows: DataFrame, features: list[str]) -> dict[float, tuple]:
    """For each origin: rows, positives, means and population variances. Bad values raise."""
    sums = [F.count("*").alias("n"), F.sum("y").alias("ones"), F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("labels")]
    for k in range(len(features)):
        v = F.col(f"x{k}")
        fine = F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
        sums += [F.avg(v).alias(f"m{k}"), F.var_pop(v).alias(f"v{k}"), F.count_if(~fine).alias(f"b{k}")]
    got = rows.groupBy("o").agg(*sums).collect()  # a row an origin
    bad = [name for k, name in enumerate(features) if any(r[f"b{k}"] for r in got)]
    labels = sum(r.labels for r in got)
    if not got or bad or labels:
        raise ValueError(f"rows {sum(r.n for r in got)}, bad labels {labels}, bad features {bad}")
    return {r.o: (r.n, r.ones, np.array([r[f"m{k}"] for k in range(len(features))]), np.array([r[f"v{k}"] for k in range(len(features))])) for r in got}


def _sums(rows: DataFrame, folds: list[tuple]) -> np.ndarray:
    """[folds, 1 + d + d * d]: loss, gradient and curvature of each fold (limit, means, scales, weights) over its rows."""
    sent = rows.sparkSession.sparkContext.broadcast(folds)
    d = len(folds[0][3])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), 1 + d + d * d))
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for k, (limit, means, scales, w) in enumerate(sent.value):
                mine = data[data[:, 0] < limit]
                x = np.column_stack([np.ones(len(mine)), (mine[:, 2:] - means) / scales])
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = np.logaddexp(0, z).sum() - mine[:, 1] @ z
                total[k] += np.concatenate([[loss], x.T @ (p - mine[:, 1]), ((x.T * (p * (1 - p))) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b) for batch in batches for b in batch.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], names=["sums"])

    got = rows.mapInArrow(local, "sums binary").repartition(8).mapInArrow(joined, "sums binary").collect()  # eight rows at most
    sent.unpersist()
    return sum((np.frombuffer(bytes(r.sums)) for r in got), np.zeros(len(folds) * (1 + d + d * d))).reshape(len(folds), -1)


def fit_folds(df: DataFrame, limits: list[float], features: list[str], target: str = "y", c: float = 0.1, origin: str | None = None, steps: int = 50, tolerance: float = 1e-9) -> list[Logistic]:
    """For each limit the minimum of |w|^2 / 2 + c * (sum of log losses) over the rows of smaller origin, the intercept free.

    Means and population deviations come from these rows (a deviation of 0 counts as 1). Null or
    non-finite features, labels beside 0 and 1, and a single class raise, as does a fit that doesn't
    settle. A step that makes a fold worse is halved.
    """
    rows = df.select((F.col(origin).cast("double") if origin else F.lit(0.0)).alias("o"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    seen = _checked(rows.filter(F.col("o") < max(limits)), features)
    folds = []
    for limit in limits:
        parts = [v for o, v in seen.items() if o < limit]
        n, ones = sum(p[0] for p in parts), sum(p[1] for p in parts)
        if not n or ones in (0, n):
            raise ValueError(f"{n} rows before {limit}, {ones} of them positive")
        means = sum(p[0] * p[2] for p in parts) / n
        spread = np.sqrt(sum(p[0] * (p[3] + (p[2] - means) ** 2) for p in parts) / n)
        start = np.zeros(len(features) + 1)
        start[0] = math.log(ones / (n - ones))
        folds.append([limit, means, np.where(spread > 0, spread, 1.0), start, n, ones / n])
    ridge = np.eye(len(features) + 1)
    ridge[0, 0] = 0.0
    step = [np.zeros(len(features) + 1) for _ in folds]
    best, open_ = [math.inf] * len(folds), list(range(len(folds)))
    for _ in range(steps):
        got = _sums(rows, [tuple(folds[k][:4]) for k in open_])
        for k, sums in zip(list(open_), got, strict=True):
            w, d = folds[k][3], len(features) + 1
            value = 0.5 * w @ ridge @ w + c * sums[0]
            if value > best[k] + 1e-12 * abs(best[k]):
                step[k] = step[k] / 2
                folds[k][3] = w - step[k]
                if np.abs(step[k]).max() < tolerance:
                    open_.remove(k)
                continue
            best[k] = value
            step[k] = -np.linalg.solve(ridge + c * sums[1 + d :].reshape(d, d), ridge @ w + c * sums[1 : 1 + d])
            folds[k][3] = w + step[k]
            if np.abs(step[k]).max() < tolerance:
                open_.remove(k)
        if not open_:
            return [Logistic(list(features), m.tolist(), s.tolist(), w[1:].tolist(), float(w[0]), n, share) for _, m, s, w, n, share in folds]
    raise RuntimeError(f"no fit after {steps} steps")


def fit(train: DataFrame, features: list[str], target: str = "y", c: float = 0.1) -> Logistic:
    """fit_folds() over all rows."""
    return fit_folds(train, [1.0], features, target, c)[0]


def rolling(df: DataFrame, origin: str, origins: list[int], features: list[str], target: str = "y", c: float = 0.1, keep: tuple[str, ...] = ()) -> DataFrame:
    """fold, origin, y, p, prevalence and the kept columns: each origin scored by a model of all earlier ones.

    The models are a few numbers a fold; the result is one plan that scores every row once.
    """
    later = sorted(origins)[1:]
    if not later:
        raise ValueError("rolling folds need two origins")
    models = fit_folds(df.filter(F.col(origin).isin(list(origins))), [float(at) for at in later], features, target, c, origin)
    out = None
    for fold, (at, model) in enumerate(zip(later, models, strict=True), 1):
        scored = model.score(df.filter(F.col(origin) == at)).select(F.lit(fold).alias("fold"), F.col(origin).alias("origin"), *keep, F.col(target).cast("int").alias("y"), "p", F.lit(model.prevalence).alias("prevalence"))
        out = scored if out is None else out.unionByName(scored)
    return out


def fit_final(df: DataFrame, origin: str, first_test: int, features: list[str], target: str = "y", c: float = 0.1) -> tuple[Logistic, dict]:
    """The model of all origins before the locked test, and its card: settings, coefficients and odds ratios."""
    model = fit_folds(df, [float(first_test)], features, target, c, origin)[0]
    card = {"rows": model.rows, "prevalence": model.prevalence, "c": c, "intercept": model.intercept, "before_origin": first_test, "coefficients": [{"feature": n, "coefficient": w, "odds_ratio": o} for n, w, o in model.odds()]}
    return model, card


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Proper scores, ranking metrics and the constant prevalence's Brier score of each fold."""
    base = scored.groupBy("fold").agg(F.avg((F.col("y") - F.col("prevalence")) ** 2).alias("prevalence_brier"), F.max("prevalence").alias("prevalence"))
    return M.proper_scores(scored, ["fold"]).join(M.ranking(scored, ["fold"]), "fold").join(base, "fold")


def choose_c(train: DataFrame, validate: DataFrame, features: list[str], target: str = "y", grid: tuple[float, ...] = (0.1, 1.0, 10.0)) -> tuple[float, list[tuple[float, float]]]:
    """The first c with the smallest validation log loss, and every c's loss."""
    losses = []
    for c in grid:
        scored = fit(train, features, target, c).score(validate).select(F.col(target).cast("int").alias("y"), "p")
        losses.append((c, M.proper_scores(scored, []).first().log_loss))
    return min(losses, key=lambda x: x[1])[0], losses
