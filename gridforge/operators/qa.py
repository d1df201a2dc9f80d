"""Quality bits and surface reflectance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the quality band, and the sensors that have cirrus.
BITS = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5}
CIRRUS_SENSORS = ("LC08", "LC09")
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
SCALE, OFFSET = 2.75e-5, -0.2


def bit_is_set(band: Column, bit: int) -> Column:
    return F.getbit(band.cast("long"), F.lit(bit)) != 0


def valid_mask(quality: Column, saturation: Column, sensor: Column, bands: list[Column], rules: tuple[str, ...] = tuple(BITS)) -> Column:
    """No enabled bit is set (cirrus for sensors that have it), nothing saturated, all bands there."""
    tests = [~bit_is_set(quality, BITS[r]) if r != "cirrus" else ~(sensor.isin(*CIRRUS_SENSORS) & bit_is_set(quality, BITS[r])) for r in rules]
    return F.coalesce(reduce(Column.__and__, [*tests, saturation == 0, *[b.isNotNull() for b in bands]]), F.lit(False))


def surface_reflectance(df: DataFrame, valid: Column, names: dict[str, str]) -> DataFrame:
    """Digital numbers to reflectance under the mask; names maps source to common bands."""
    return df.withColumns({new: F.when(valid, F.col(old) * SCALE + OFFSET) for old, new in names.items()})


def composite(df: DataFrame, keys: list[str], bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Per cell and epoch the exact median of each band and the number of valid observations."""
    return df.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands], F.count(bands[0]).alias("valid_observation_count"))
