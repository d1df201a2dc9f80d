"""One evaluation of several models' out-of-fold probabilities: metrics by fold, bins, coverage, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M

#: Names that the label and the probability may have, the preferred ones first.
TARGETS, PROBABILITIES = ("target_transition_5y", "y_true", "target", "y"), ("probability_raw", "probability", "p")
LOSSES, GAINS = ["log_loss", "brier", "ece"], ["average_precision", "roc_auc"]


@dataclass
class Evaluation:
    folds: DataFrame
    bins: DataFrame
    coverage: DataFrame
    summary: DataFrame


def predictions(models: dict[str, DataFrame]) -> DataFrame:
    """model, fold, y, p of all models, one under the other; a model without folds is one fold, ``all``."""
    out = None
    for name, df in models.items():
        column = lambda wanted: next((c for c in wanted if c in df.columns), None)  # noqa: B023, E731
        y, p = column(TARGETS), column(PROBABILITIES)
        if y is None or p is None:
            raise ValueError(f"{name} has no label or no probability")
        fold = F.col("fold").cast("string") if "fold" in df.columns else F.lit("all")
        part = df.select(F.lit(name).alias("model"), fold.alias("fold"), F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no models")
    return out


def fold_table(rows: DataFrame, by: list[str], bins: int = 10, strategy: str = "quantile", line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(metrics, bins) of each group: proper scores, ranking, calibration error, bias and its size, and
    with ``line`` the calibration line; the columns of the parts don't clash."""
    table = M.reliability(rows, by, bins, strategy)
    folds = M.proper_scores(rows, by).join(M.ranking(rows, by), by).join(M.calibration_error(table, by), by).withColumn("absolute_bias", F.abs("bias"))
    if line:
        lines = [(*g, a, b) for g, (a, b) in M.calibration_lines(rows, by).items()]  # a row a model and fold
        schema = rows.select(*by, F.lit(0.0).alias("calibration_intercept"), F.lit(0.0).alias("calibration_slope")).schema
        folds = folds.join(rows.sparkSession.createDataFrame(lines, schema), by)
    return folds, table


def evaluate(models: dict[str, DataFrame], target: float = 0.8, bins: int = 10, strategy: str = "quantile", line: bool = True) -> Evaluation:
    """All models in the same passes. Folds are calibrated on those that sort before them; the summary has
    each model's equal-weight means, deviations and worst folds, joined with its mean coverage, which is
    null where a model has one fold."""
    rows = predictions(models)
    M.validate(rows)
    by = ["model", "fold"]
    folds, table = fold_table(rows, by, bins, strategy, line)
    covered = M.temporal_coverage(rows, target, by=("model",)).withColumn("absolute_coverage_gap", F.abs("coverage_gap"))
    means = covered.groupBy("model").agg(F.count("*").alias("coverage_folds"), F.avg("coverage").alias("mean_coverage"), F.avg("absolute_coverage_gap").alias("mean_absolute_coverage_gap"), F.avg("mean_set_size").alias("mean_set_size"))
    summary = M.summarise(folds, ["model"], LOSSES, GAINS).join(means, "model", "left")
    return Evaluation(folds, table, covered, summary)
