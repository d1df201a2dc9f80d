"""Vote strata, stratified samples with design weights, weighted scores and method selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import deterministic_key

SALTS = 64


def vote_strata(df: DataFrame, methods: list[str]) -> DataFrame:
    """Adds common_valid, vote and stratum (0 no vote, 2 unanimous, else 1) from built_<m>, valid_<m>."""
    vote = sum((F.col(f"built_{m}") for m in methods[1:]), F.col(f"built_{methods[0]}"))
    valid = F.least(*[F.col(f"valid_{m}") for m in methods]) if len(methods) > 1 else F.col(f"valid_{methods[0]}")
    return df.withColumns({"common_valid": (valid == 1).cast("int"), "vote": vote, "stratum": F.when(vote == 0, 0).when(vote == len(methods), 2).otherwise(1)})


def stratified_sample(df: DataFrame, by: list[str], cell: str, target: int, seed: int) -> DataFrame:
    """The target rows of smallest key in each stratum, with population, sample_size and weight.

    A feature of this operator is its limit. Keys are hashes, so a first cut by hash value bounds what
    a large stratum brings to the windows: rows beyond four times the target's share can't be chosen
    unless the cut keeps too few, and then the whole stratum takes part, a part of it in each window.
    """
    keyed = df.withColumn("key", deterministic_key(seed, *[F.col(c) for c in by], F.col(cell)))
    size = df.groupBy(*by).agg(F.count("*").alias("population"))
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = keyed.join(size, by).withColumn("in_cut", share <= 4.0 * target / F.col("population"))
    enough = kept.groupBy(*by).agg((F.sum(F.col("in_cut").cast("int")) >= F.least(F.lit(target), F.max("population"))).alias("enough"))
    pool = kept.join(enough, by).filter(F.col("in_cut") | ~F.col("enough")).withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    # a stratum's rows are first thinned out in SALTS parts, so no window sees a whole stratum
    part = Window.partitionBy(*by, "_salt").orderBy("key", cell)
    pool = pool.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= target).drop("_salt")
    w = Window.partitionBy(*by).orderBy("key", cell)
    chosen = pool.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= target)
    return chosen.withColumn("sample_size", F.least(F.lit(target).cast("long"), F.col("population"))).withColumn("weight", F.col("population") / F.col("sample_size")).drop("in_cut", "enough")


def greedy_separation(pool: DataFrame, by: list[str], target: int, distance: float) -> DataFrame:
    """Picks in key order that keep the distance; it is relaxed to two thirds, one third and zero
    while picks are missing, and earlier picks stay. Adds the last distance tried. Order matters, so
    one group of the (bounded) oversample is one pandas call."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        chosen: list[int] = []
        used = 0.0
        for used in (distance, 2 * distance / 3, distance / 3, 0.0):
            for k in range(len(pdf)):
                if len(chosen) >= target:
                    break
                if k not in chosen and all(math.hypot(pdf["x_m"].iloc[k] - pdf["x_m"].iloc[j], pdf["y_m"].iloc[k] - pdf["y_m"].iloc[j]) >= used for j in chosen):
                    chosen.append(k)
            if len(chosen) >= target:
                break
        return pdf.iloc[chosen].assign(used_distance_m=float(used))

    schema = ", ".join(f"`{c}` {t}" for c, t in pool.dtypes) + ", used_distance_m double"
    return pool.groupBy(*by).applyInPandas(pick, schema)


def weighted_f1(df: DataFrame, by: list[str]) -> DataFrame:
    """Design-weighted precision, recall and F1 of columns truth, pred, weight; 0 where undefined."""
    part = lambda t, p: F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("weight")).otherwise(0.0))
    sums = df.groupBy(*by).agg(part(1, 1).alias("tp"), part(0, 1).alias("fp"), part(1, 0).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rank_methods(scores: DataFrame) -> DataFrame:
    """1 to n by mean F1, least F1, reversal rate and name. Methods are few."""
    w = Window.orderBy(F.desc("mean_yearly_weighted_f1"), F.desc("minimum_yearly_weighted_f1"), F.asc("reversal_rate"), F.asc("method"))
    return scores.withColumn("rank", F.row_number().over(w))


def select_method(scores: DataFrame, tolerance: float) -> tuple[str, str | None]:
    """Within the tolerance of the best mean, then the best least F1, then the least reversal rate
    (both to 1e-12 and a relative 1e-5); more than one left needs a decision."""
    close = lambda a, b: F.abs(a - b) <= F.lit(1e-12) + 1e-5 * F.abs(b)
    left = scores.join(F.broadcast(scores.agg(F.max("mean_yearly_weighted_f1").alias("_m")))).filter(F.col("mean_yearly_weighted_f1") >= F.col("_m") - tolerance)
    left = left.join(F.broadcast(left.agg(F.max("minimum_yearly_weighted_f1").alias("_f")))).filter(close(F.col("minimum_yearly_weighted_f1"), F.col("_f")))
    left = left.join(F.broadcast(left.agg(F.min("reversal_rate").alias("_r")))).filter(close(F.col("reversal_rate"), F.col("_r")))
    found = [r.method for r in left.select("method").limit(2).collect()]
    return ("PASS", found[0]) if len(found) == 1 else ("MANUAL_DECISION_REQUIRED", None)
