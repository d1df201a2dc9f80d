"""Leakage-safe features, folds, standardisation and contract checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import slot

#: Named feature sets.
BASE = ("distance_to_built_m_t", "slope_degrees", "built_fraction_11x11_t", "recent_local_growth_5y_t")
FEATURE_SETS = {
    "base": (*BASE, "population_density_t"),
    "log_population": (*BASE, "log_population"),
    "log_distance": ("log_distance", *BASE[1:], "log_population"),
    "slope_squared": (*BASE, "slope_squared", "log_population"),
    "growth": (*BASE, "built_growth", "log_population"),
    "log_distance_growth": ("log_distance", *BASE[1:], "built_growth", "log_population"),
}


def engineer(df: DataFrame) -> DataFrame:
    """log1p of population and distance, squared slope, and fraction times growth and log population.
    A negative or non-finite population, distance or slope raises."""
    number = lambda c, low: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) & ((F.col(c) >= 0) if low else F.lit(True)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be finite and not negative")).cast("double"))
    people, distance, slope = number("population_density_t", True), number("distance_to_built_m_t", True), number("slope_degrees", False)
    return df.withColumns({"log_population": F.log1p(people), "log_distance": F.log1p(distance), "slope_squared": slope * slope, "built_growth": F.col("built_fraction_11x11_t") * F.col("recent_local_growth_5y_t"), "built_population": F.col("built_fraction_11x11_t") * F.log1p(people)})


def standardise(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the training mean over the training deviation (population form; 0 counts as 1)."""
    got = train.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    return df.withColumns({c: (F.col(c) - got[f"m{k}"]) / (got[f"s{k}"] or 1.0) for k, c in enumerate(columns)})


def rolling_folds(origins: list[int]) -> list[tuple[list[int], int]]:
    """(training origins, validation origin): each origin is validated by all before it."""
    ordered = sorted(origins)
    return [(ordered[:k], ordered[k]) for k in range(1, len(ordered))]


def check_folds(train: list[int], validate: int, test: int | None = None, evaluate_test: bool = False) -> None:
    if evaluate_test:
        raise ValueError("the final test is locked")
    if not train or max(train) >= validate or (test is not None and validate >= test):
        raise ValueError("training must come before validation, and validation before the test")


def check_no_leakage(columns: list[str], labels: tuple[str, ...] = ("target_year", "target_transition_5y")) -> None:
    """Columns that name the target year or later states, beside the labels, raise."""
    leaks = [c for c in columns if c not in labels and re.search(r"target|_t1\b|t_plus|future", c)]
    if leaks:
        raise ValueError(f"columns of the target's time: {leaks}")


def check_cell_time(df: DataFrame, horizon: int = 5) -> None:
    """Unique (cell_id, forecast_origin), horizon, binary label, origin not built and valid, at most
    one conversion a cell; two grouped passes."""
    key = df.groupBy("cell_id", "forecast_origin").agg(F.count("*").alias("n"))
    bad = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("target_year") != F.col("forecast_origin") + horizon).alias("horizon"),
        F.count_if(~F.col("target_transition_5y").isin(0, 1)).alias("label"),
        F.count_if((F.col("built_state_final_t") != 0) | (F.col("built_state_valid_t") != 1)).alias("origin"),
    ).first()
    twice = df.groupBy("cell_id").agg(F.sum("target_transition_5y").alias("k")).filter("k > 1")
    if not bad.rows or bad.horizon or bad.label or bad.origin or not key.filter("n > 1").isEmpty() or not twice.isEmpty():
        raise ValueError(f"cell-time contract: {bad.asDict()}")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys are unique on both sides, checked inside the plan: a repeated key raises."""
    def checked(df):
        return df.join(df.groupBy(*on).agg(F.count("*").alias("_n")), on).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).cast("long")).otherwise(F.col("_n"))).filter("_n = 1").drop("_n")

    return checked(left).join(checked(right), on, how)


def time_step(origin: Column, first: int, years: int) -> Column:
    """Steps of so many years since the first origin."""
    return (origin - F.lit(float(first))) / float(years)


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds place, 1 to n in order of the keys, which are unique: rows are ordered within range partitions
    and a partition's first place comes from the counts of those before it."""
    ranged = df.withColumn("_slot", slot(df, keys[-1]))
    counts = ranged.groupBy(*keys[:-1], "_slot").agg(F.count("*").alias("_n"))  # a row a slice and leading key
    before = counts.select(*keys[:-1], "_slot", F.coalesce(F.sum("_n").over(Window.orderBy(*keys[:-1], "_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys[:-1], "_slot").orderBy(keys[-1])
    return ranged.join(before, [*keys[:-1], "_slot"]).withColumn("place", F.col("_before") + F.row_number().over(inside)).drop("_slot", "_before")


def population_density(df: DataFrame, people: Column, area_m2: Column, source_year: Column) -> DataFrame:
    """Adds people a square kilometre of the native pixel, 0 where the source has none, and the source's year."""
    return df.withColumns({"population_density_t": F.coalesce(people / area_m2 * 1e6, F.lit(0.0)), "population_source_year": source_year.cast("int")})
