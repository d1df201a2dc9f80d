"""Reports over cells, epochs and catalogues: counts, comparisons, audits, lookups and label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_percentiles(dense: DataFrame, by: list[str], count: str, shares=(0.0, 0.25, 0.5, 0.75, 0.9, 1.0), covered=(0.25, 0.5, 0.75)) -> DataFrame:
    """Mean and percentiles of a count over all cells (a missing one is 0) and over those above 0.
    Counts take few values, so tasks add them up by value before the shuffle."""
    n = F.coalesce(F.col(count), F.lit(0)).cast("double")
    name = lambda p: f"p{round(100 * p)}"
    some = F.when(n > 0, n)
    out = [F.avg(n).alias("mean")] + [F.percentile(n, F.lit(p)).alias(name(p)) for p in shares] + [F.percentile(some, F.lit(p)).alias(f"covered_{name(p)}") for p in covered]
    return dense.groupBy(*by).agg(*out)


def frequency(dense: DataFrame, by: list[str], count: str) -> DataFrame:
    """Cells of each count; a missing count is 0."""
    return dense.groupBy(*by, F.coalesce(F.col(count), F.lit(0)).cast("long").alias("observations")).agg(F.count("*").alias("cells"))


def compare_epochs(df: DataFrame, metrics: list[str], first: int, second: int, epoch: str = "epoch") -> DataFrame:
    """metric, first, second, difference: one row a metric."""
    long = df.filter(F.col(epoch).isin(first, second)).unpivot([epoch], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    at = lambda e: F.max(F.when(F.col(epoch) == e, F.col("value")))
    return long.groupBy("metric").agg(at(first).alias("first"), at(second).alias("second")).withColumn("difference", F.col("second") - F.col("first"))


def largest_name(columns: list[str], prefix: str = "") -> Column:
    """The name (less its prefix) of the largest column, of equal ones the first; nulls don't count."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return F.coalesce(*[F.when(F.col(c) == top, F.lit(c.removeprefix(prefix))) for c in columns])


def density_audit(coarse: DataFrame, fine: DataFrame, by: list[str], count: str, density: str, fine_m2: float) -> DataFrame:
    """Native total and largest count beside the total put together again from densities a km2 on the fine grid."""
    native = coarse.groupBy(*by).agg(F.sum(count).cast("double").alias("native_total"), F.max(count).cast("double").alias("native_maximum"))
    again = fine.groupBy(*by).agg((F.sum(density) * fine_m2 / 1e6).alias("fine_total"), F.max(density).alias("maximum_density"))
    both = native.join(again, by)
    return both.withColumn("difference_pct", F.try_divide(100.0 * (F.col("fine_total") - F.col("native_total")), F.col("native_total")))


def point_values(points: DataFrame, raster: DataFrame, keys: list[str], x: str, y: str, resolution: float, value: str, missing: float) -> DataFrame:
    """Points with the value of the raster cell that each lies in: an equi-join on cell numbers.
    No cell, or the raster's value for none, gives NULL; every point stays."""
    at = points.withColumns({"_cx": F.floor(F.col(x) / resolution).cast("long"), "_cy": F.floor(F.col(y) / resolution).cast("long")})
    cells = raster.select(*keys, F.col("col").cast("long").alias("_cx"), F.col("row").cast("long").alias("_cy"), F.when(F.col(value) != missing, F.col(value)).alias(value))
    return at.join(cells, [*keys, "_cx", "_cy"], "left").drop("_cx", "_cy")


def tracking(df: DataFrame, support: DataFrame, cell: list[str], core_cells: int, cell_ha: float = 0.09, least_pct: float = 80.0, epoch: str = "epoch", built: str = "final") -> DataFrame:
    """Per epoch on the cells valid in all epochs: built area, its share, support in per cent of the core, and a flag."""
    pct = 100.0 * F.count("*") / core_cells
    on = df.join(support.filter("supported = 1").select(*cell), cell, "left_semi")
    out = on.groupBy(epoch).agg((F.sum(built) * cell_ha).alias("built_area_ha"), (F.sum(built) / F.count("*")).alias("built_share"), pct.alias("support_pct"))
    return out.withColumn("status", F.when(F.col("support_pct") >= least_pct, "PASS").otherwise("WARNING_LOW_SUPPORT"))


def split_summary(df: DataFrame, origin: str, target: str, splits: dict[str, list[int]], inspected: tuple[str, ...]) -> DataFrame:
    """Rows of each split and origin; positives only of splits that may be looked at."""
    named = F.create_map(*[x for name, origins in splits.items() for o in origins for x in (F.lit(o), F.lit(name))])
    seen = lambda c: F.when(F.col("split").isin(*inspected), c)
    grouped = df.withColumn("split", F.try_element_at(named, F.col(origin))).filter("split is not null").groupBy("split", F.col(origin).alias("origin"))
    return grouped.agg(F.count("*").alias("n_rows"), F.sum(F.col(target).cast("long")).alias("positives")).withColumn("positives", seen(F.col("positives")))


def anchor_epochs(coverage: DataFrame, floor: float) -> DataFrame:
    """The earliest, middle and latest epoch whose coverage reaches the floor; the middle is nearest to
    halfway, then of larger coverage, then earlier. No epoch gives an empty result."""
    fit = coverage.filter(F.col("coverage") >= floor).select("epoch", "coverage")
    low, high = fit.agg(F.min("epoch"), F.max("epoch")).first()
    ends = fit.agg(F.min("epoch").alias("earliest"), F.max("epoch").alias("latest"), F.min_by("epoch", F.struct(F.abs(F.col("epoch") - F.lit(((low or 0) + (high or 0)) / 2)), -F.col("coverage"), F.col("epoch"))).alias("middle"))
    return ends.filter("earliest is not null").unpivot([], ["earliest", "middle", "latest"], "anchor", "epoch")


def even_positions(n: int, wanted: int) -> list[int]:
    """Positions spread evenly over n, both ends included, without repeats; gaps fill from the start."""
    if wanted >= n:
        return list(range(n))
    steps = [round(k * (n - 1) / max(wanted - 1, 1)) for k in range(wanted)]
    chosen = dict.fromkeys(steps)
    for k in range(n):
        if len(chosen) >= wanted:
            break
        chosen.setdefault(k)
    return sorted(chosen)


def check_spacing(epochs: list[int], step: int) -> None:
    if any(b - a != step for a, b in zip(epochs, epochs[1:], strict=False)):
        raise ValueError(f"epochs {epochs} aren't {step} apart")


def label_faults(labels: DataFrame, samples: DataFrame, key: str, label: str, date: str, epoch: str, years: int = 2) -> DataFrame:
    """One row of counts: ids without a sample, samples without a label row, repeated ids, labels beside
    0, 1 and NULL, and labelled rows whose date is missing or more than ``years`` from the epoch."""
    far = F.col(date).isNull() | (F.abs(F.year(date) - F.col(epoch)) > years)
    own = labels.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("bad_label"), F.count_if(F.col(label).isin(0, 1) & far).alias("bad_date"))
    due = samples.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("m"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    here = F.col("n").isNotNull()
    return own.join(due, "_key", "full_outer").agg(
        total("n", F.col("m").isNull()).alias("unknown_ids"), total("m", ~here).alias("missing_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"),
        total("bad_label", here).alias("bad_labels"), total("bad_date", here).alias("bad_dates"),
    )
