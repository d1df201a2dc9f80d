"""Neighbourhoods, distances, slopes and patches on dense grids, as windows and joins.

Box sums are separable: one window along rows, one along columns. On a grid of any size the work is
linear, and a partition is a row or column of one epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import shared_path


def box_sums(df: DataFrame, columns: list[str], size: int, by: str = "epoch") -> DataFrame:
    """Adds <column>_sum: the sum over the size x size box around each cell. NULL counts as 0 and the
    frame must be dense (see grid.densify)."""
    r = size // 2
    along = Window.partitionBy(by, "row").orderBy("col").rangeBetween(-r, r)
    down = Window.partitionBy(by, "col").orderBy("row").rangeBetween(-r, r)
    first = df.withColumns({f"_{c}": F.sum(F.coalesce(c, F.lit(0))).over(along) for c in columns})
    return first.withColumns({f"{c}_sum": F.sum(f"_{c}").over(down) for c in columns}).drop(*[f"_{c}" for c in columns])


def built_fraction(df: DataFrame, size: int, by: str = "epoch") -> DataFrame:
    """built_fraction (0 without a valid cell) and valid_fraction (always of size squared, so smaller
    at the border) from columns built and valid."""
    flagged = df.withColumns({"v": F.coalesce(F.col("valid"), F.lit(0)), "b": F.when(F.col("valid") == 1, F.coalesce("built", F.lit(0))).otherwise(0)})
    summed = box_sums(flagged, ["v", "b"], size, by)
    return summed.withColumns({"built_fraction": F.when(F.col("v_sum") > 0, F.col("b_sum") / F.greatest("v_sum", F.lit(1))).otherwise(0.0), "valid_fraction": F.col("v_sum") / float(size * size)}).drop("v", "b", "v_sum", "b_sum")


def recent_growth(pairs: DataFrame, size: int, by: str = "epoch") -> DataFrame:
    """Share of newly built among eligible cells of the box in the transition that ended at the
    epoch; 0 with available = 0 where there is none. pairs: dense, with target and common."""
    flagged = pairs.withColumns({"g": F.coalesce("target", F.lit(0)), "c": F.coalesce("common", F.lit(0))})
    summed = box_sums(flagged, ["g", "c"], size, by)
    return summed.withColumns({"growth": F.when(F.col("c_sum") > 0, F.col("g_sum") / F.greatest("c_sum", F.lit(1))).otherwise(0.0), "available": (F.col("c_sum") > 0).cast("int")}).drop("g", "c", "g_sum", "c_sum")


def distance_to_built(df: DataFrame, resolution: float, by: str = "epoch") -> DataFrame:
    """(by, row, col, distance_m): exact Euclidean distance to the nearest built cell, NULL without any.

    Two passes: windows give each cell the distance to the nearest built cell of its column; then the
    lower envelope of parabolas along each row, a numpy step on one row at a time.
    """
    built = F.when(F.coalesce("built", F.lit(0)) == 1, F.col("row"))
    up = Window.partitionBy(by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by, "col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    gap = F.least(F.col("row") - F.last(built, True).over(up), F.first(built, True).over(down) - F.col("row"))
    columns = df.select(by, "row", "col", gap.cast("double").alias("gap"))

    rows = columns.groupBy(by, "row").agg(F.sort_array(F.collect_list(F.struct("col", "gap"))).alias("cells"))  # a row of the grid

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            edge = cells.offsets.to_numpy()
            col, gap = (cells.values.field(k) for k in (0, 1))
            x, f = col.to_numpy(zero_copy_only=False).astype(float), gap.to_numpy(zero_copy_only=False).astype(float) ** 2
            found = np.concatenate([_lower(x[a:b], f[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
            away = np.sqrt(found) * resolution
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edge)))
            inside = slice(edge[0], edge[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), col[inside], pa.array(away, mask=~np.isfinite(away))], names=[by, "row", "col", "distance_m"])

    kind = dict(df.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in (by, "row", "col")) + ", distance_m double"
    return rows.mapInArrow(envelope, schema)


def _lower(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """min over j of (x - x_j)**2 + f_j at every x (sorted), by the envelope of the parabolas."""
    keep = np.flatnonzero(~np.isnan(f))
    if not len(keep):
        return np.full(len(x), np.nan)
    hull: list[int] = []
    cut: list[float] = []
    for j in keep:
        while hull:
            i = hull[-1]
            s = ((f[j] + x[j] ** 2) - (f[i] + x[i] ** 2)) / (2 * (x[j] - x[i]))
            if s > cut[-1]:
                break
            hull.pop()
            cut.pop()
        cut.append(s if hull else -np.inf)
        hull.append(int(j))
    at = np.searchsorted(np.array(cut), x, "left") - 1
    best = np.array(hull)[np.maximum(at, 0)]
    return (x - x[best]) ** 2 + f[best]


def slope_degrees(df: DataFrame, value: str, resolution: float, by: str = "epoch") -> DataFrame:
    """Slope from central differences; a missing neighbour gives NULL."""
    along = Window.partitionBy(by, "row").orderBy("col")
    down = Window.partitionBy(by, "col").orderBy("row")
    dx = (F.lead(value).over(along) - F.lag(value).over(along)) / (2.0 * resolution)
    dy = (F.lead(value).over(down) - F.lag(value).over(down)) / (2.0 * resolution)
    return df.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def patches(df: DataFrame, cell_ha: float = 0.09, by: str = "epoch", rounds: int = 64) -> DataFrame:
    """(by, nump, mps_ha, built_area_ha): patches of built cells that touch at sides or corners.

    Runs of built cells along a row are found by windows; runs of neighbouring rows that touch are
    joined on (by, row); labels then go to their least run until nothing changes, with the label of
    the label taken in every round, so long patches need few rounds. Runs, not cells, are iterated.
    Lineage is cut by reliable checkpoints.
    """
    shared_path(df.sparkSession)
    built = df.filter(F.col("built") == 1).select(by, "row", "col")
    w = Window.partitionBy(by, "row").orderBy("col")
    runs = built.withColumn("g", F.col("col") - F.row_number().over(w)).groupBy(by, "row", "g").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    runs = runs.select(by, "row", "low", "high", F.struct("row", "low").alias("id")).checkpoint()
    a, b = runs.alias("a"), runs.alias("b")
    touch = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.row") + 1 == F.col("b.row")) & (F.col("a.low") <= F.col("b.high") + 1) & (F.col("b.low") <= F.col("a.high") + 1)
    pairs = a.join(b, touch).select(F.col(f"a.{by}").alias(by), F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    edges = pairs.unionByName(pairs.select(by, F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    labels = runs.select(by, "id", F.col("id").alias("label"))
    for _ in range(rounds):
        near = edges.join(labels.select(by, F.col("id").alias("v"), "label"), [by, "v"]).groupBy(by, F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, [by, "id"], "left").select(by, "id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(by, F.col("id").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, [by, "new"], "left").select(by, "id", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")).checkpoint()
        labels = step.select(by, "id", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            break
    else:
        raise RuntimeError("patches did not settle")
    area = runs.join(labels, [by, "id"]).groupBy(by).agg(F.countDistinct("label").alias("nump"), F.sum(F.col("high") - F.col("low") + 1).alias("cells"))
    return area.select(by, F.col("nump").cast("long").alias("nump"), (F.col("cells") * cell_ha / F.col("nump")).alias("mps_ha"), (F.col("cells") * cell_ha).alias("built_area_ha"))


def inside_polygons(df: DataFrame, rings: list[list[tuple[float, float]]], x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Adds inside: pixel-centre membership by the even-odd rule over all rings."""
    corners = [np.array(r, float) for r in rings]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
            odd = np.zeros(len(pdf), bool)
            for ring in corners:
                for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0), strict=True):
                    crosses = (y1 > py) != (y2 > py)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        odd ^= crosses & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            yield pdf.assign(inside=odd)

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", inside boolean")
