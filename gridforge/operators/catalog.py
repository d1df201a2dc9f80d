"""Scene catalogues: summaries, calendar windows, coverage, selection and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalise(df: DataFrame, keys: list[str], dates: list[str], numbers: list[str], flags: list[str]) -> DataFrame:
    """Strict dates, numbers that become NULL where they are none, flags that are false where
    missing; repeated keys raise."""
    out = df.withColumns({**{c: F.to_date(c) for c in dates}, **{c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}, **{c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes"), F.lit(False)) for c in flags}})
    if not out.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys {keys}")
    return out


def summary(scenes: DataFrame, by: list[str]) -> DataFrame:
    """Scenes, positive coverage, and medians and maximum of the valid fraction of each group."""
    return scenes.groupBy(*by).agg(F.count("asset_id").alias("scene_count"), F.sum(F.col("has_coverage").cast("int")).alias("positive_scenes"), F.median("valid_fraction").alias("median_valid_fraction"), F.max("valid_fraction").alias("maximum_valid_fraction"), F.median("cloud").alias("median_cloud"))


def inventory(scenes: DataFrame) -> DataFrame:
    """Per epoch: scenes, with coverage, candidates; sorted distinct sensors; first and last date."""
    return scenes.groupBy("epoch").agg(F.count("*").alias("scenes"), F.count_if("has_coverage").alias("covering"), F.array_join(F.sort_array(F.collect_set("sensor")), ",").alias("sensors"), F.min("acquired").alias("first_date"), F.max("acquired").alias("last_date"))


def candidate_windows(spark: SparkSession, lengths: tuple[int, ...] = (3, 4, 6, 12), epochs: tuple[int, ...] = ()) -> DataFrame:
    """Every window of whole months from each start month of an epoch; windows that cross the year's
    end begin in the year before. Half-open. (epochs x lengths x 12 rows.)"""
    base = spark.range(12).select((F.col("id") + 1).cast("int").alias("month"))
    out = base.withColumn("months", F.explode(F.array(*[F.lit(k) for k in lengths]))).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    crosses = F.col("month") + F.col("months") > 13
    start = F.make_date(F.col("epoch") - F.when(crosses, 1).otherwise(0), F.col("month"), F.lit(1))
    return out.select("epoch", F.format_string("m%02d_%02d", "month", "months").alias("window_name"), F.col("months").alias("number_of_months"), start.alias("window_start"), F.add_months(start, F.col("months")).alias("window_end"))


def window_join(scenes: DataFrame, windows: DataFrame, sensors: dict[str, list[str]]) -> DataFrame:
    """Scenes of each window and sensor mode: equal epoch, date within, sensor of the mode, coverage.

    The windows are at most epochs x lengths x 12 rows, so they are broadcast: an equi-join on epoch
    with the dates as residual condition.
    """
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*[F.lit(s) for s in v]).alias("list")) for m, v in sensors.items()]))
    w = windows.withColumn("m", modes).select("*", F.col("m.mode").alias("sensor_mode"), F.col("m.list").alias("sensor_list")).drop("m")
    joined = scenes.join(F.broadcast(w), "epoch").filter((F.col("acquired") >= F.col("window_start")) & (F.col("acquired") < F.col("window_end")))
    return joined.filter(F.array_contains("sensor_list", F.col("sensor")) & F.col("has_coverage")).drop("sensor_list")


def observation_metrics(observed: DataFrame, core: DataFrame, by: list[str]) -> DataFrame:
    """Per group over all core cells: share with at least one and three observations (percent), mean,
    median and maximum, and the number of observations. Cells without any observation count as zero.

    All comes from one table, how many cells have how many observations."""
    size = core.count()
    spread = observed.groupBy(*by, "cell_id").agg(F.count("*").alias("n")).groupBy(*by, "n").agg(F.count("*").alias("cells"))
    total = F.sum(F.col("n") * F.col("cells"))
    some = spread.groupBy(*by).agg(F.sum("cells").alias("seen"), total.alias("observations"), F.sum(F.when(F.col("n") >= 3, F.col("cells")).otherwise(0)).alias("deep"), F.max("n").alias("maximum_valid_observations_core"), F.sort_array(F.collect_list(F.struct("n", "cells"))).alias("spread"))
    # the values at the two middle places, the unseen cells first; the table has a row a count
    upto = F.transform("spread", lambda x: F.struct(x["n"].alias("n"), (F.lit(size) - F.col("seen") + F.aggregate(F.filter("spread", lambda y: y["n"] <= x["n"]), F.lit(0).cast("long"), lambda t, y: t + y["cells"])).alias("upto")))
    at = lambda place: F.coalesce(F.filter("places", lambda x: x["upto"] > place)[0]["n"], F.lit(0)) if place >= 0 else F.lit(0)
    middle = lambda place: F.when(F.lit(place) < F.lit(size) - F.col("seen"), F.lit(0).cast("long")).otherwise(at(place))
    out = some.withColumn("places", upto)
    median = (middle((size - 1) // 2) + middle(size // 2)) / 2.0
    return out.select(*by, (100.0 * F.col("seen") / size).alias("coverage_at_least_1_core_pct"), (100.0 * F.col("deep") / size).alias("coverage_at_least_3_core_pct"), (F.col("observations") / size).alias("mean_valid_observations_core"), median.alias("median_valid_observations_core"), "maximum_valid_observations_core", "observations")


def choose_sensor_mode(results: DataFrame, least: float = 95.0, tolerance: float = 0.5) -> DataFrame:
    """One row a window: the primary mode if it covers enough or nothing else gains more than the
    tolerance, else the supplemental one. A window without a primary row raises."""
    w = Window.partitionBy("epoch", "window_name")
    primary = F.max(F.when(F.col("sensor_mode") == "primary_only", F.col("coverage_at_least_1_core_pct"))).over(w)
    other = F.max(F.when(F.col("sensor_mode") == "primary_plus_supplemental", F.col("coverage_at_least_1_core_pct"))).over(w)
    checked = F.when(primary.isNotNull(), primary).otherwise(F.raise_error(F.lit("window without primary row")).cast("double"))
    use_other = F.coalesce((checked < least) & (other - checked > tolerance), F.lit(False))
    chosen = F.when(use_other, "primary_plus_supplemental").otherwise("primary_only")
    return results.withColumn("_chosen", chosen).filter(F.col("sensor_mode") == F.col("_chosen")).drop("_chosen")


def select_protocol(results: DataFrame, least: float = 95.0, depth: float = 80.0, tolerance: float = 0.5) -> DataFrame:
    """Per epoch the shortest window that covers enough, of those the best by depth, coverage, median,
    scenes and name; if none does, the best by coverage first, marked as a fallback."""
    one = choose_sensor_mode(results, least, tolerance)
    good = F.col("coverage_at_least_1_core_pct") >= least
    c1, c3, median = (F.col(c) for c in ("coverage_at_least_1_core_pct", "coverage_at_least_3_core_pct", "median_valid_observations_core"))
    first = lambda a, b: F.when(F.col("_good"), a).otherwise(b)
    ranked = one.withColumn("_good", good).withColumn(
        "_place",
        F.row_number().over(
            Window.partitionBy("epoch").orderBy(
                F.col("_good").desc(),
                first(F.col("number_of_months").cast("double"), -c1),
                first(-(c3 >= depth).cast("double"), -c3),
                first(-c3, -median),
                first(-median, F.col("number_of_months").cast("double")),
                first(-c1, F.lit(0.0)),
                F.col("scene_count").desc(),
                F.col("window_name"),
            )
        ),
    )
    status = F.when(F.col("_good"), "PASS_SHORTEST_ACCEPTABLE").otherwise("FALLBACK_BELOW_95")
    return ranked.filter("_place = 1").withColumns({"threshold_passed": F.col("_good"), "selection_status": status}).drop("_good", "_place")


def compare_selections(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ADDED, REMOVED or UNCHANGED for every key of either selection."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").otherwise("UNCHANGED").alias("change"))


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given; dropDuplicates would promise no order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
