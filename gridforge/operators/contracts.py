"""Contracts of tables: each fault is a row (name, count of rows that break it), found in one pass a table.

A contract's faults can be looked at (``*_faults``) or enforced (``enforce`` raises if any count isn't 0).
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def counted(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """fault, rows: how many rows meet each of the conditions, a null condition counting as met."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in faults.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(f"`{n}`").alias("rows")) for n in faults])).alias("f")).select("f.*")


def enforce(faults: DataFrame, what: str) -> None:
    found = {r.fault: r.rows for r in faults.filter("rows <> 0").collect()}
    if found:
        raise ValueError(f"{what}: {found}")


def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """fault, rows: rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("rows")).select(F.lit(name).alias("fault"), "rows")


def cell_time_faults(cell_time: DataFrame, origins: list[int], horizon: int = 5) -> DataFrame:
    """Keys, horizon, labels, states at the origin and the list of origins of the model's table."""
    rows = counted(cell_time, {
        "horizon": F.col("target_year") != F.col("forecast_origin") + horizon,
        "label": ~F.col("target").isin(0, 1),
        "built_at_origin": F.col("built_state") != 0,
        "origin": ~F.col("forecast_origin").isin(origins),
    })
    there = cell_time.select("forecast_origin").distinct().agg(F.count_if(F.col("forecast_origin").isin(origins)).alias("n"))
    missing = there.select(F.lit("missing_origin").alias("fault"), (F.lit(len(origins)) - F.col("n")).cast("long").alias("rows"))
    return rows.unionByName(repeated(cell_time, ["cell_id", "forecast_origin"], "repeated_key")).unionByName(missing)


def demand_faults(cell_time: DataFrame, demand: DataFrame, cell_ha: float = 0.09) -> DataFrame:
    """Demand against the cell-time rows of its period: counts, area of the new cells, periods on one side only."""
    seen = cell_time.groupBy(F.col("forecast_origin").alias("period_start"), F.col("target_year").alias("period_end")).agg(F.count("*").alias("eligible"), F.sum("target").alias("new"))
    both = demand.join(seen, ["period_start", "period_end"], "full")
    return counted(both, {
        "eligible_count": ~F.col("eligible_nonbuilt_cells").eqNullSafe(F.col("eligible")),
        "new_count": ~F.col("new_built_cells").eqNullSafe(F.col("new")),
        "area": F.abs(F.col("observed_new_built_area_ha") - F.col("new_built_cells") * cell_ha) > 1e-6 + 1e-5 * F.abs(F.col("new_built_cells") * cell_ha),
    })


def tracking_faults(metrics: DataFrame, epochs: list[int]) -> DataFrame:
    """Shares within 0 and 1, patches not negative, one support, all epochs once."""
    rows = counted(metrics, {"pba": ~F.col("pba").between(0, 1), "patches": (F.col("nump") < 0) | (F.col("mps_ha") < 0), "epoch": ~F.col("epoch").isin(epochs)})
    one = metrics.agg(F.count_distinct("tracking_support_area_ha").alias("s"), F.count_distinct("epoch").alias("e"))
    more = one.select(F.explode(F.array(F.struct(F.lit("support").alias("fault"), F.abs(F.col("s") - 1).alias("rows")), F.struct(F.lit("missing_epoch").alias("fault"), F.abs(F.lit(len(epochs)) - F.col("e")).alias("rows")))).alias("f")).select("f.*")
    return rows.unionByName(more).unionByName(repeated(metrics, ["epoch"], "repeated_epoch"))


def validate_final_tables(cell_time: DataFrame, demand: DataFrame, metrics: DataFrame, epochs: list[int], columns: list[str]) -> None:
    """The release's contract; a stored partition of the model or a missing column raises too."""
    missing = [c for c in columns if c not in cell_time.columns]
    if missing or "temporal_partition" in cell_time.columns:
        raise ValueError(f"the cell-time table lacks {missing}" if missing else "partitions of the model must not be stored")
    origins = sorted(epochs)[:-1]
    if demand.count() != len(origins):
        raise ValueError(f"demand must have {len(origins)} periods")
    for what, faults in (("cell-time", cell_time_faults(cell_time, origins)), ("demand", demand_faults(cell_time, demand)), ("tracking", tracking_faults(metrics, epochs))):
        enforce(faults, what)


def evaluation_faults(labels: DataFrame, per_epoch: int, per_class: int) -> DataFrame:
    """Epochs with too few certain labels (0 or 1) or without both, and classes with too few in all."""
    certain = labels.filter(F.col("label").isin(0, 1))
    epochs = counted(certain.groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")), {"few_labels": F.col("n") < per_epoch, "one_class": F.col("k") < 2})
    classes = certain.agg(*[F.count_if(F.col("label") == v).alias(f"c{v}") for v in (0, 1)])
    return epochs.unionByName(classes.select(F.lit("few_of_class").alias("fault"), sum((F.col(f"c{v}") < per_class).cast("long") for v in (0, 1)).alias("rows")))


def feature_faults(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, nulls, not_finite: values that can't be read as numbers count as null."""
    parts = []
    for f in features:
        v = F.col(f).try_cast("double")
        parts.append(F.struct(F.lit(f).alias("feature"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v) | (F.abs(v) == math.inf)).alias("not_finite")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("f")).select("f.*")


def mask_faults(df: DataFrame, built: str, valid: str) -> DataFrame:
    """Built values other than 0 and 1, and cells whose built mask isn't the validity band."""
    return counted(df, {"domain": F.col(built).isNotNull() & ~F.coalesce(F.col(built).isin(0, 1), F.lit(True)), "mask": F.col(built).isNotNull() != (F.coalesce(F.col(valid), F.lit(0)) == 1)})


def schema_faults(df: DataFrame, wanted: StructType) -> list[str]:
    """Where names, order or types of the columns differ."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in wanted]
    return [] if have == want else [f"{w} wanted, {h} there" for h, w in zip(have + [None] * (len(want) - len(have)), want + [None] * (len(have) - len(want)), strict=True) if h != w]


def reference_faults(observed: dict[str, Any], reference: dict[str, Any], tolerance: float = 1e-9) -> list[str]:
    """Fields of a frozen reference (grid, catalogue, image) that differ; numbers and lists of them within tolerance."""
    def same(a: Any, b: Any) -> bool:
        if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
            return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        return math.isclose(a, b, rel_tol=0, abs_tol=tolerance) if number(a) and number(b) else a == b

    return sorted(k for k in reference if k not in observed or not same(observed[k], reference[k]))


def schema_roles(df: DataFrame, keys: list[str], target: str, features: list[str]) -> dict[str, Any]:
    """Every column with its role; a column with none is auxiliary. Keys and target are never features."""
    clash = sorted({*keys, target} & set(features))
    if clash:
        raise ValueError(f"{clash} can't be features")
    role = lambda c: "key" if c in keys else "target" if c == target else "feature" if c in features else "auxiliary"
    return {"columns": [{"name": f.name, "type": f.dataType.simpleString(), "role": role(f.name)} for f in df.schema]}


def data_dictionary(spark: SparkSession, df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """column, type, definition of every column; one without a definition raises."""
    missing = [c for c in df.columns if c not in definitions]
    if missing:
        raise ValueError(f"no definition of {missing}")
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), definitions[f.name]) for f in df.schema], "column string, type string, definition string")
