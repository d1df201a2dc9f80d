"""Coverage of epochs, anchors for sampling, and area rows of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import greedy_separation, stratified_sample, vote_strata

#: Columns that may hold a coverage, the strongest first.
COVERAGE_COLUMNS = ("covered_core_pct", "core_coverage_pct", "valid_core_coverage_pct", "valid_fraction_core", "valid_core_fraction", "covered_grid_pct")
#: Strata by number of methods that vote.
STRATA = {0: "unanimous_nonbuilt", 1: "disagreement", 2: "unanimous_built"}


def first_column(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """The first of the wanted columns that is there."""
    return next((c for c in wanted if c in columns), None)


def percentage(column: str) -> Column:
    """A documented fraction or percentage in per cent; a value that isn't finite raises."""
    v = F.col(column).cast("double")
    low = column.lower()
    out = v * 100 if "fraction" in low else F.when(v.between(0, 1.000001), v * 100).otherwise(v) if "pct" not in low else v
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, out).otherwise(F.raise_error(F.lit(f"{column} is not finite")).cast("double"))


def coverage_table(quality: DataFrame, areas: DataFrame, core_ha: float, epochs: list[int]) -> DataFrame:
    """epoch, core_coverage_pct, coverage_source: the best documented coverage of each epoch, else the
    median valid area over the core's area. An epoch without either raises."""
    column = first_column(quality.columns, COVERAGE_COLUMNS)
    wanted = quality.sparkSession.createDataFrame([(e,) for e in epochs], "epoch int")
    known = quality.join(wanted, "epoch", "left_semi")
    shown = known.groupBy("epoch").agg(F.max(percentage(column)).alias("shown")) if column else known.select("epoch", F.lit(None).cast("double").alias("shown")).limit(0)
    from_area = areas.groupBy("epoch").agg((F.median("valid_area_ha") / core_ha * 100).alias("computed"))
    out = wanted.join(shown, "epoch", "left").join(from_area, "epoch", "left")
    value = F.coalesce("shown", "computed")
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("an epoch has no coverage")).cast("double"))
    return out.select("epoch", checked.alias("core_coverage_pct"), F.when(F.col("shown").isNotNull(), F.lit(column)).otherwise(F.lit("candidate_valid_area_over_core_area")).alias("coverage_source"))


def anchor_epochs(coverage: DataFrame, fail_below: float, warn_below: float, count: int) -> DataFrame:
    """Of the epochs with enough coverage ``count``, spread evenly from the first to the last, with a flag.
    A feature of this operator is its count."""
    if count <= 0:
        raise ValueError("the count must be positive")
    good = coverage.filter(F.col("core_coverage_pct") >= fail_below)
    w = Window.orderBy("epoch")  # a row an epoch
    placed = good.withColumns({"place": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy())})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("n") - 1) / float(max(count - 1, 1))).cast("int"))
    chosen = placed.filter((F.col("n") <= count) | F.array_contains(wanted, F.col("place").cast("int")))
    flag = F.when(F.col("core_coverage_pct") < warn_below, "WARN").otherwise("PASS")
    return chosen.withColumn("quality_flag", flag).drop("place", "n")


def sample_epoch(cells: DataFrame, methods: list[str], targets: dict[str, int], seed: int, distance: float, factor: int = 4) -> DataFrame:
    """Separated samples of each epoch's three strata with weights of what was really picked.

    cells: epoch, cell_id, x_m, y_m and built_<m>, valid_<m> of each method. Each stratum brings
    factor times its target at most (the operator's limit) to the greedy pick.
    """
    voted = vote_strata(cells, methods).filter("common_valid = 1")
    name = F.element_at(F.create_map(*[x for k, v in STRATA.items() for x in (F.lit(k), F.lit(v))]), F.col("stratum"))
    voted = voted.withColumn("stratum_name", name)
    out = None
    for stratum, target in sorted(targets.items()):
        pool = stratified_sample(voted.filter(F.col("stratum_name") == stratum), ["epoch", "stratum"], "cell_id", target * factor, seed).drop("sample_size", "weight", "place")
        picked = greedy_separation(pool, ["epoch", "stratum"], target, distance)
        out = picked if out is None else out.unionByName(picked)
    sizes = out.groupBy("epoch", "stratum").agg(F.count("*").alias("sample_size"))
    out = out.join(sizes, ["epoch", "stratum"]).withColumn("sample_weight", F.col("population") / F.col("sample_size"))
    return out.withColumn("sample_id", F.concat_ws("_", F.col("epoch").cast("string"), F.lpad(F.col("cell_id").cast("string"), 9, "0")))


def enrich_area(rows: DataFrame, by: list[str]) -> DataFrame:
    """Threshold rows with pixel counts rounded, square metres as hectares, the built fraction (null of
    no area) and the change of built area since the epoch before."""
    ha = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 10_000
    out = rows.withColumns({"valid_pixels": F.rint(F.coalesce("valid_pixels", F.lit(0.0))).cast("long"), "valid_area_ha": ha("valid_area_m2"), "built_area_ha": ha("built_area_m2"), "nonbuilt_area_ha": ha("nonbuilt_area_m2")})
    out = out.withColumn("built_fraction", F.when(F.col("valid_area_ha") > 0, F.col("built_area_ha") / F.col("valid_area_ha")))
    return out.withColumn("change_from_previous_epoch_ha", F.col("built_area_ha") - F.lag("built_area_ha").over(Window.partitionBy(*by).orderBy("epoch"))).drop("valid_area_m2", "built_area_m2", "nonbuilt_area_m2")


def tracking_table(areas: DataFrame, patches: DataFrame, support_ha: float, core_ha: float, warn_below: float) -> DataFrame:
    """epoch, built area, its share of the fixed support, patches, support's share of the core, and a flag."""
    share = 100.0 * support_ha / core_ha
    joined = areas.join(patches, "epoch", "left").fillna({"nump": 0, "mps_ha": 0.0})
    return joined.select("epoch", F.lit(support_ha).alias("tracking_support_area_ha"), F.lit(share).alias("tracking_support_pct_of_core"), "built_area_ha", (F.col("built_area_ha") / support_ha).alias("pba"), "nump", "mps_ha", F.lit("PASS" if share >= warn_below else "WARN_SUPPORT").alias("tracking_quality_flag"))


def zonal_area(cells: DataFrame, by: list[str], mask: str, zone: str, cell_m2: float = 900.0) -> DataFrame:
    """Square metres under the mask inside the zone, and their share of the zone in per cent."""
    inside = F.col(zone) == 1
    masked = F.count_if(inside & (F.coalesce(F.col(mask), F.lit(0)) == 1))
    return cells.groupBy(*by).agg((masked * cell_m2).alias("area_m2"), F.try_divide(100.0 * masked, F.count_if(inside)).alias("coverage_pct"))


def sensor_contributions(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and share of cells with an observation, of each epoch and sensor."""
    return counts.groupBy(*by).agg(F.avg("obs").alias("mean_obs"), F.median("obs").alias("median_obs"), (100.0 * F.avg((F.col("obs") > 0).cast("double"))).alias("coverage_pct"))


def update_labels(samples: DataFrame, labels: DataFrame, key: str, column: str) -> DataFrame:
    """samples with the column taken from labels where the key is there, else as it was."""
    new = labels.select(key, F.col(column).alias("_new"), F.lit(True).alias("_there"))
    return samples.join(new, key, "left").withColumn(column, F.when(F.col("_there"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_there")


def diagnose(chain: DataFrame, stages: list[str]) -> DataFrame:
    """epoch, dominant_stage, dominant_loss, statement: the stage that loses most support, and since the
    epoch before whether the support has grown. stages are columns of shares, in order of the chain."""
    losses = [(b, F.col(a) - F.col(b)) for a, b in zip(stages, stages[1:], strict=False)]
    most = F.greatest(*[v for _, v in losses]) if len(losses) > 1 else losses[0][1]
    stage = F.coalesce(*[F.when(v == most, F.lit(s)) for s, v in losses])
    last = F.col(stages[-1])
    change = last - F.lag(last).over(Window.orderBy("epoch"))  # a row an epoch
    trend = F.when(change.isNull(), "first epoch").when(change > 0, "support grew").when(change < 0, "support fell").otherwise("support is unchanged")
    return chain.select("epoch", stage.alias("dominant_stage"), most.alias("dominant_loss"), F.concat_ws("; ", F.concat(F.lit("most is lost at "), stage), trend).alias("statement"))
