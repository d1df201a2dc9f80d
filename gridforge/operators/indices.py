"""Spectral indices as column expressions; NULL stands for a masked value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qa import BANDS

INDICES = ("savi", "mndwi", "ndbi", "ibi", "ibui", "vbswir1_bi", "ndbsui")


def safe_ratio(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """a / b, NULL where b is within epsilon of zero."""
    return F.when(F.abs(b) > epsilon, a / F.when(F.abs(b) > epsilon, b))


def with_indices(df: DataFrame, epsilon: float = 1e-6, soil: float = 0.5, count: str | None = None, least: int = 1) -> DataFrame:
    """Adds the seven indices; all are NULL unless every band is there and enough observations are."""
    base = F.lit(True)
    for b in BANDS:
        base = base & F.col(b).isNotNull()
    if count:
        base = base & (F.col(count) >= least)
    blue, green, red, nir, s1, s2 = (F.when(base, F.col(b)) for b in BANDS)
    first = df.withColumns(
        {
            "savi": safe_ratio((nir - red) * (1 + soil), nir + red + soil, epsilon),
            "mndwi": safe_ratio(green - s1, green + s1, epsilon),
            "ndbi": safe_ratio(s1 - nir, s1 + nir, epsilon),
            "vbswir1_bi": safe_ratio(s1 - blue, s1 + blue, epsilon),
        }
    )
    middle = (F.col("savi") + F.col("mndwi")) / 2
    root = F.sqrt(F.when((red >= 0) & (s1 >= 0), red * s1))
    return first.withColumns(
        {
            "ibi": safe_ratio(F.col("ndbi") - middle, F.col("ndbi") + middle, epsilon),
            "ibui": F.col("ndbi") - F.col("savi") - F.col("mndwi"),
            "ndbsui": safe_ratio(s2 + root - (red + s1), s2 + root + red + s1, epsilon),
        }
    )


def classify(df: DataFrame, thresholds: DataFrame, keys: list[str], index: str = "value") -> DataFrame:
    """built = index > threshold (strictly; NULL where the index is), valid = the index is there."""
    joined = df.join(thresholds, keys, "left")
    return joined.withColumns({"built": F.when(F.col(index).isNotNull() & F.col("threshold").isNotNull(), (F.col(index) > F.col("threshold")).cast("int")), "valid": F.col(index).isNotNull().cast("int")})
