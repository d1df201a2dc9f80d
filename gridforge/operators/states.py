"""Absorbing states along epochs, transition labels, demand, reversals and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absorbing(df: DataFrame, cell: list[str], epoch: str = "epoch", raw: str = "raw", valid: str = "valid") -> DataFrame:
    """Adds final and corrected: a cell stays built once a valid epoch has shown it so.

    final is NULL where the epoch is invalid; that neither shows nor resets built history. corrected
    marks valid epochs whose raw 0 was overruled. One sort per cell serves both.
    """
    before = Window.partitionBy(*cell).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col(valid) == 1, F.col(raw))).over(before), F.lit(0))
    return df.withColumn("_ever", seen).withColumns(
        {
            "final": F.when(F.col(valid) == 1, F.greatest(F.col(raw), F.col("_ever"))),
            "corrected": F.when((F.col(valid) == 1) & (F.col(raw) == 0) & (F.col("_ever") == 1), 1).otherwise(0),
        }
    ).drop("_ever")


def transitions(df: DataFrame, cell: list[str], step: int = 1, epoch: str = "epoch", least_count: int = 3, count: str = "obs") -> DataFrame:
    """Pairs of an epoch and the one ``step`` later of every cell that has the earlier one.

    common: both valid; eligible: common and not built at first; target: eligible and built then
    (NULL where not eligible); reversal: raw goes from 1 to 0 under common; quality: 0 not common, 2
    both counts reach least_count and nothing was corrected at the target, else 1. A cell without
    a row at epoch + step pairs with nothing: the next row is taken only if it is that epoch.
    """
    w = Window.partitionBy(*cell).orderBy(epoch)
    there = F.lead(epoch).over(w) == F.col(epoch) + step
    later: dict[str, Column] = {f"{c}_2": F.when(there, F.lead(c).over(w)) for c in ("raw", "valid", "final", "corrected", count)}
    common = (F.col("valid") == 1) & (F.coalesce("valid_2", F.lit(0)) == 1)
    eligible = common & (F.col("final") == 0)
    return df.withColumns(later).withColumns(
        {
            "target_epoch": F.col(epoch) + step,
            "common": common.cast("int"),
            "eligible": eligible.cast("int"),
            "target": F.when(eligible, (F.col("final_2") == 1).cast("int")),
            "reversal": (common & (F.col("raw") == 1) & (F.col("raw_2") == 0)).cast("int"),
            "quality": F.when(~common, 0).when((F.col(count) >= least_count) & (F.col(f"{count}_2") >= least_count) & (F.col("corrected_2") == 0), 2).otherwise(1),
        }
    )


def demand(pairs: DataFrame, cell_ha: float = 0.09, epoch: str = "epoch") -> DataFrame:
    """Per period: common, eligible and newly built cells and their areas; map-side sums only."""
    return (
        pairs.groupBy(F.col(epoch).alias("period_start"), F.col("target_epoch").alias("period_end"))
        .agg(F.sum("common").alias("common_valid_cells"), F.sum("eligible").alias("eligible_nonbuilt_cells"), F.coalesce(F.sum("target"), F.lit(0)).alias("new_built_cells"))
        .withColumns({"eligible_nonbuilt_area_ha": F.col("eligible_nonbuilt_cells") * cell_ha, "observed_new_built_area_ha": F.col("new_built_cells") * cell_ha})
    )


def synchronise_demand(demand_: DataFrame, cells: DataFrame, cell_ha: float = 0.09) -> DataFrame:
    """Counts and areas of demand rows replaced by those of the released cells; an empty group raises."""
    own = cells.groupBy(F.col("forecast_origin").alias("period_start"), F.col("target_year").alias("period_end")).agg(F.count("*").alias("n"), F.sum("target_transition_5y").alias("k"), F.max((~F.col("target_transition_5y").isin(0, 1)).cast("int")).alias("odd"))
    joined = demand_.join(own, ["period_start", "period_end"], "left")
    checked = lambda c: F.when(F.col("n").isNotNull() & (F.col("odd") == 0), c).otherwise(F.raise_error(F.lit("no cells, or labels that aren't binary")).cast("long"))
    return joined.withColumns({"eligible_nonbuilt_cells": checked(F.col("n")), "eligible_nonbuilt_area_ha": F.col("n") * cell_ha, "new_built_cells": checked(F.col("k")), "observed_new_built_area_ha": F.col("k") * cell_ha}).select(*demand_.columns)


def reversal_rate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of cells that were built and common and are raw non-built next; NULL without any."""
    base = F.sum(F.when((F.col("common") == 1) & (F.col("raw") == 1), 1).otherwise(0))
    return pairs.groupBy(*by).agg(base.alias("built_cells"), F.sum("reversal").alias("reversals")).withColumn("reversal_rate", F.try_divide("reversals", "built_cells"))


def tracking_support(df: DataFrame, cell: list[str], epochs: int) -> DataFrame:
    """Cells that are valid in every one of the epochs."""
    return df.groupBy(*cell).agg((F.sum("valid") == epochs).cast("int").alias("supported"))
