"""Histograms by epoch and index, Otsu thresholds, quantiles and area change, all as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str = "value", buckets: int = 256, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(by, bucket, bucket_mean, bucket_count) of equal-width buckets between a group's extremes (or
    fixed bounds), with true bucket means. NULL values are left out."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if bounds:
        placed = known.withColumns({"low": F.lit(float(bounds[0])), "high": F.lit(float(bounds[1]))})
    else:
        placed = known.join(known.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")), by)
    width = (F.col("high") - F.col("low")) / buckets
    bucket = F.when(width > 0, F.least(F.greatest(F.floor((F.col(value) - F.col("low")) / F.when(width > 0, width)), F.lit(0)), F.lit(buckets - 1))).otherwise(0)
    return placed.withColumn("bucket", bucket.cast("int")).groupBy(*by, "bucket").agg(F.avg(value).alias("bucket_mean"), F.count("*").alias("bucket_count"))


def otsu(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, threshold, bucket_count, valid_pixel_count) per group of buckets.

    Only finite buckets of positive count take part. The split of largest between-class variance
    wins, the first of equal ones; the threshold is midway between its two bucket means. No buckets,
    or fewer than two distinct means, give a failure status and no threshold.
    """
    good = hist.filter((F.col("bucket_count") > 0) & F.col("bucket_mean").isNotNull() & ~F.isnan("bucket_mean") & (F.abs("bucket_mean") < float("inf")))
    w = Window.partitionBy(*by).orderBy("bucket_mean")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    sums = good.withColumns(
        {
            "w0": F.sum("bucket_count").over(upto).cast("double"),
            "s0": F.sum(F.col("bucket_count") * F.col("bucket_mean")).over(upto),
            "n": F.sum("bucket_count").over(whole).cast("double"),
            "s": F.sum(F.col("bucket_count") * F.col("bucket_mean")).over(whole),
            "next": F.lead("bucket_mean").over(w),
            "buckets": F.count("*").over(whole),
            "spread": F.max("bucket_mean").over(whole) - F.min("bucket_mean").over(whole),
        }
    )
    w1 = F.col("n") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    split = F.struct(F.round(F.col("w0") * w1 * gap * gap / (F.col("n") * F.col("n")), 12).alias("variance"), (-F.col("bucket_mean")).alias("first"), ((F.col("bucket_mean") + F.col("next")) / 2).alias("threshold"))
    out = sums.groupBy(*by).agg(F.max(F.when(F.col("next").isNotNull() & (w1 > 0), split)).alias("best"), F.max("buckets").alias("buckets"), F.max("spread").alias("spread"), F.max("n").cast("long").alias("n"))
    every = hist.select(*by).distinct().join(out, by, "left")
    status = F.when(F.col("n").isNull(), "FAIL_NO_VALID_PIXELS").when((F.col("buckets") < 2) | (F.col("spread") <= 0), "FAIL_DEGENERATE_HISTOGRAM").otherwise("PASS")
    return every.select(*by, status.alias("status"), F.when(status == "PASS", F.col("best.threshold")).alias("threshold"), F.coalesce("buckets", F.lit(0)).cast("long").alias("bucket_count"), F.coalesce("n", F.lit(0)).alias("valid_pixel_count"))


def histogram_quantile(hist: DataFrame, by: list[str], probability: float) -> DataFrame:
    """The first bucket mean whose cumulative count reaches the share."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("bucket_mean").rowsBetween(Window.unboundedPreceding, 0)
    marked = hist.filter("bucket_count > 0").withColumns({"c": F.sum("bucket_count").over(upto), "n": F.sum("bucket_count").over(w)})
    return marked.filter(F.col("c") >= F.col("n") * probability).groupBy(*by).agg(F.min("bucket_mean").alias("quantile"))


def area_change(df: DataFrame, by: list[str], area: str, epoch: str = "epoch") -> DataFrame:
    """Adds the change of area from the epoch before, NULL in the first."""
    return df.withColumn("change_from_previous_epoch_ha", F.col(area) - F.lag(area).over(Window.partitionBy(*by).orderBy(epoch)))
