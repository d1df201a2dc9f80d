"""Manifests of products and scenes: selection, lookups, windows of the catalogue and unions.

Manifests have a row for each product or scene; lookups are joins, and only dictionaries that a caller
asks for (a row an epoch) come to the driver.
"""

from __future__ import annotations

import calendar
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import listed

#: States of a finished product, and roles of sensors.
PASS_STATES = ("PASS", "COMPLETED", "EXISTS")
ROLES = ("primary", "supplemental", "diagnostic_only")


def require(df: DataFrame, columns: list[str], what: str = "the table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")


def require_unique(df: DataFrame, keys: list[str], what: str = "the table") -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what} repeats {keys}")


def require_epochs(df: DataFrame, epochs: list[int], column: str = "epoch") -> None:
    """The column's distinct values, in order, must be the epochs; at most one more value than these is read."""
    found = sorted(r[0] for r in df.select(column).distinct().limit(len(epochs) + 1).collect())
    if found != sorted(epochs):
        raise ValueError(f"{found} is there, {sorted(epochs)} wanted")


def passed(df: DataFrame, state: str = "state", states: tuple[str, ...] = PASS_STATES) -> DataFrame:
    """Rows whose state, in any case, is that of a finished product."""
    return df.filter(F.upper(F.trim(F.col(state).cast("string"))).isin(list(states)))


def epoch_sources(manifest: DataFrame, epochs: list[int]) -> DataFrame:
    """epoch, source_composite_asset, source_count_asset, index_asset: the candidates' rows joined with the
    indices' rows of one manifest, one of each for each epoch."""
    require(manifest, ["epoch", "product_type", "asset_id", "source_composite_asset", "source_count_asset", "state"], "the manifest")
    rows = passed(manifest).filter(F.col("epoch").isin(epochs))
    candidates = rows.filter("product_type = 'candidates'").select("epoch", "source_composite_asset", "source_count_asset")
    indices = rows.filter("product_type = 'indices'").select("epoch", F.col("asset_id").alias("index_asset"))
    for side in (candidates, indices):
        require_unique(side, ["epoch"], "the manifest")
    joined = candidates.join(indices, "epoch")
    require_epochs(joined, epochs)
    return joined


def candidate_epochs(manifest: DataFrame, bands: list[str], exact: bool = False) -> DataFrame:
    """Finished candidates, one an epoch, with band_names as a list that must hold the bands (be them, in order)."""
    rows = passed(manifest).filter("product_type = 'candidates'").withColumn("band_names", listed(F.col("band_names")))
    require_unique(rows, ["epoch"], "the manifest")
    wanted = F.array(*[F.lit(b) for b in bands])
    good = F.col("band_names") == wanted if exact else F.size(F.array_except(wanted, "band_names")) == 0
    if not rows.filter(~good).isEmpty():
        raise ValueError(f"an epoch lacks {bands}")
    return rows


def completed_composites(manifest: DataFrame, epochs: list[int] | None = None) -> DataFrame:
    """Composites with status PASS in any case, of the epochs if given, one an epoch."""
    rows = passed(manifest, "status", ("PASS",))
    rows = rows.filter(F.col("epoch").isin(epochs)) if epochs is not None else rows
    require_unique(rows, ["epoch"], "the composites")
    return rows


def one_row(manifest: DataFrame, product_type: str, epoch: int) -> dict:
    """The one finished row of a product at an epoch."""
    found = passed(manifest).filter((F.col("product_type") == product_type) & (F.col("epoch") == epoch)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{product_type} of {epoch} is there {len(found)} times")
    return found[0].asDict()


def asset_map(manifest: DataFrame) -> tuple[dict[int, str], dict[tuple[int, int], str], str]:
    """Assets by epoch, by period, and the one of the tracking support; a manifest has a few rows an epoch."""
    rows = manifest.filter(F.col("product_type").isin("state", "transition", "tracking_support")).select("product_type", "epoch", "period_start", "period_end", "asset_id").collect()
    support = [r.asset_id for r in rows if r.product_type == "tracking_support"]
    if len(support) != 1:
        raise ValueError("exactly one tracking support is needed")
    states = {int(r.epoch): r.asset_id for r in rows if r.product_type == "state"}
    return states, {(int(r.period_start), int(r.period_end)): r.asset_id for r in rows if r.product_type == "transition"}, support[0]


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows, columns aligned by name; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def number_or_zero(column: Column) -> Column:
    """A statistic that a reducer may not have given: missing and unreadable ones are 0."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def sensor_policy(policy: dict, epoch: int) -> dict[str, list[str]]:
    """Sensors by role at an epoch; keys may be numbers or their text."""
    raw = policy.get(epoch, policy.get(str(epoch)))
    if raw is None:
        raise KeyError(epoch)
    return {role: list(raw.get(role, [])) for role in ROLES}


def policy_frame(spark: SparkSession, policy: dict, epochs: list[int]) -> DataFrame:
    """epoch, sensor, role, as rows to join scenes with."""
    rows = [(e, s, role) for e in epochs for role, sensors in sensor_policy(policy, e).items() for s in sensors]
    return spark.createDataFrame(rows, "epoch int, sensor string, role string")


def windows_frame(spark: SparkSession, epochs: list[int], lengths: list[int], cross_year: bool = True) -> DataFrame:
    """epoch, window_name, months, window_start, window_end (half-open): every start month and length; a
    window that crosses the year's end starts in the year before."""
    rows = []
    for e in epochs:
        for n in lengths:
            for start in range(1, 13):
                over = start + n - 1 > 12
                if over and not cross_year:
                    continue
                first = date(e - over, start, 1)
                months = first.year * 12 + first.month - 1 + n
                name = f"{calendar.month_abbr[start]}-{calendar.month_abbr[(start + n - 2) % 12 + 1]}_{n}m"
                rows.append((e, name, n, first, date(months // 12, months % 12 + 1, 1)))
    return spark.createDataFrame(rows, "epoch int, window_name string, months int, window_start date, window_end date")


def diagnostic_range(epoch: Column, before: int, after: int) -> tuple[Column, Column]:
    """The half-open range of dates around an epoch."""
    return F.make_date(epoch - before, F.lit(1), F.lit(1)), F.make_date(epoch + after + 1, F.lit(1), F.lit(1))


def scene_features(scenes: DataFrame, core_m2: float, context_m2: float) -> DataFrame:
    """Calendar parts, valid fractions and flags of scenes (acquired, sensor, role, valid_core_m2, valid_context_m2).

    Fixed values: the day after which a sensor's line corrector is off, and that of its orbit's drift.
    """
    seven = F.col("sensor") == "LE07"
    return scenes.withColumns({
        "acquisition_year": F.year("acquired"), "acquisition_month": F.month("acquired"), "day_of_year": F.dayofyear("acquired"),
        "valid_fraction_core": number_or_zero(F.col("valid_core_m2")) / core_m2, "valid_fraction_context": number_or_zero(F.col("valid_context_m2")) / context_m2,
        "slc_off": seven & (F.col("acquired") >= F.lit("2003-05-31").cast("date")), "orbit_drift": seven & (F.col("acquired") >= F.lit("2017-02-07").cast("date")),
        "has_positive_core_coverage": number_or_zero(F.col("valid_core_m2")) > 0, "candidate_for_composite": F.col("role") != "diagnostic_only",
    })


def exact_scenes(scenes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scenes of the one chosen protocol of each epoch: its sensors, its half-open window, with coverage.

    chosen: epoch, window_name, sensor_mode, sensor_keys (by comma), window_start, window_end,
    selection_status. An epoch without a scene raises.
    """
    protocols = chosen.select("epoch", F.explode(listed(F.col("sensor_keys"))).alias("sensor"), "window_start", "window_end", F.col("window_name").alias("selected_window_name"), F.col("sensor_mode").alias("selected_sensor_mode"), "selection_status")
    inside = (F.col("acquired") >= F.col("window_start")) & (F.col("acquired") < F.col("window_end"))
    found = scenes.filter("has_coverage").join(protocols, ["epoch", "sensor"]).filter(inside).drop("window_start", "window_end")
    empty = chosen.select("epoch").join(found.select("epoch").distinct(), "epoch", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0].epoch} has no scene with coverage")
    return found


def scene_footprint(scenes: DataFrame, cells: list[str]) -> DataFrame:
    """Whether any scene of an epoch covers a cell: the greatest of all, 0 elsewhere."""
    return scenes.groupBy("epoch", *cells).agg(F.coalesce(F.max("covered"), F.lit(0)).cast("int").alias("footprint"))
