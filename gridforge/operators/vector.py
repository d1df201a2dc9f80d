"""Shapes on the driver and their use on cells and features.

A shape is a few rings (an administrative unit, a study area); what it is applied to is a DataFrame.
Rings follow the even-odd rule, so holes are rings like any other. Offsets and unions are done on the
grid, by the cells' centres, as all later use is on cells.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import GridSpec


@dataclass(frozen=True)
class Shape:
    """Rings of (x, y) corners, each without its first corner at the end."""

    rings: tuple[tuple[tuple[float, float], ...], ...]

    @classmethod
    def of(cls, *rings) -> Shape:
        """Repeated neighbouring corners and rings of fewer than three corners are left out."""
        clean = []
        for ring in rings:
            corners: list[tuple[float, float]] = []
            for x, y, *_ in ring:
                if not corners or corners[-1] != (x, y):
                    corners.append((float(x), float(y)))
            while len(corners) > 1 and corners[0] == corners[-1]:
                corners.pop()
            if len(corners) >= 3:
                clean.append(tuple(corners))
        return cls(tuple(clean))

    @classmethod
    def from_geojson(cls, geometry: dict[str, Any]) -> Shape:
        if geometry["type"] == "Polygon":
            return cls.of(*geometry["coordinates"])
        if geometry["type"] == "MultiPolygon":
            return cls.of(*[ring for part in geometry["coordinates"] for ring in part])
        raise ValueError(f"no area in a {geometry['type']}")

    def to_geojson(self) -> dict[str, Any]:
        return {"type": "MultiPolygon", "coordinates": [[[list(c) for c in (*ring, ring[0])]] for ring in self.rings]}

    def bounds(self) -> tuple[float, float, float, float]:
        x, y = zip(*[c for ring in self.rings for c in ring], strict=True)
        return min(x), min(y), max(x), max(y)

    def contains(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the points lie inside, by the even-odd rule."""
        odd = np.zeros(len(x), bool)
        for ring in self.rings:
            for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True):
                if y1 != y2:
                    odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return odd

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the points are from the nearest edge; 0 inside."""
        best = np.full(len(x), np.inf)
        for ring in self.rings:
            for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True):
                dx, dy = x2 - x1, y2 - y1
                share = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1)
                best = np.minimum(best, np.hypot(x - x1 - share * dx, y - y1 - share * dy))
        return np.where(self.contains(x, y), 0.0, best)

    def faults(self) -> list[str]:
        """What makes the shape invalid: no ring, or edges of a ring that cross."""
        found = [] if self.rings else ["empty"]
        for k, ring in enumerate(self.rings):
            edges = list(zip(ring, (*ring[1:], ring[0]), strict=True))
            n = len(edges)
            if any(_cross(*edges[i], *edges[j]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i):
                found.append(f"ring {k} crosses itself")
        return found

    def area(self) -> float:
        """Area of the shape; rings inside an odd number of others are holes."""
        total = 0.0
        for k, ring in enumerate(self.rings):
            x, y = map(np.array, zip(*ring, strict=True))
            own = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
            around = sum(bool(Shape((other,)).contains(x[:1], y[:1])[0]) for j, other in enumerate(self.rings) if j != k)
            total += -own if around % 2 else own
        return total

    def hull(self) -> Shape:
        """The convex hull of all corners, counter-clockwise."""
        points = sorted({c for ring in self.rings for c in ring})
        half = []
        for order in (points, points[::-1]):
            side: list[tuple[float, float]] = []
            for p in order:
                while len(side) > 1 and _turn(side[-2], side[-1], p) <= 0:
                    side.pop()
                side.append(p)
            half += side[:-1]
        return Shape.of(half)


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _cross(a, b, c, d) -> bool:
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0


def valid_shape(shape: Shape | None) -> Shape | None:
    """The shape as it is if valid, null and empty ones too; of one whose ring crosses itself the parts
    that the even-odd rule has inside, with corners at the crossings."""
    if shape is None or not shape.rings or not shape.faults():
        return shape
    rings: list[list[tuple[float, float]]] = []
    for ring in shape.rings:
        rings += _simple(list(ring))
    return Shape.of(*rings)


def _simple(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A ring cut at its first crossing into two, as long as there is one."""
    n = len(ring)
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        for j in range(i + 2, n):
            c, d = ring[j], ring[(j + 1) % n]
            if (j + 1) % n != i and _cross(a, b, c, d):
                share = _turn(c, d, a) / (_turn(c, d, a) - _turn(c, d, b))
                at = (a[0] + share * (b[0] - a[0]), a[1] + share * (b[1] - a[1]))
                return _simple([at, *ring[i + 1 : j + 1]]) + _simple([*ring[: i + 1], at, *ring[j + 1 :]])
    return [ring]


def area_ha(shapes: list[Shape]) -> float:
    """Area of projected shapes in hectares; none raises."""
    total = sum(s.area() for s in shapes) / 10_000
    if total <= 0:
        raise ValueError("the area is zero")
    return total


def core_and_buffer(spark: SparkSession, grid: GridSpec, core: list[Shape], buffer_m: float, hull: bool = True) -> DataFrame:
    """(row, col, x_m, y_m, in_core, in_context) of the cells whose centre lies in the core, the union of
    its shapes, or within ``buffer_m`` of it (of its hull). Rows of the grid are worked off apart."""
    around = Shape.of(*[c for s in core for c in s.rings])
    base = around.hull() if hull else around
    west, north, step, width = grid.xmin, grid.ymax, grid.resolution, grid.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = west + (np.arange(width) + 0.5) * step
        for pdf in batches:
            for row in pdf["id"]:
                y = np.full(width, north - (row + 0.5) * step)
                in_core = np.any([s.contains(x, y) for s in core], axis=0)
                near = in_core | (base.distance(x, y) <= buffer_m)
                at = np.flatnonzero(near)
                yield pd.DataFrame({"row": np.full(len(at), row), "col": at, "x_m": x[at], "y_m": y[at], "in_core": in_core[at], "in_context": True})

    return spark.range(grid.height).mapInPandas(run, "row long, col long, x_m double, y_m double, in_core boolean, in_context boolean")


def cell_table(cells: DataFrame, grid: GridSpec, epsg: int, anchor: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Context cells with their places on the grid that is anchored for all areas, an id of these, and the area."""
    res = int(grid.resolution)
    gx = F.floor((F.col("x_m") - anchor[0]) / grid.resolution + 1e-9).cast("long")
    gy = F.floor((F.col("y_m") - anchor[1]) / grid.resolution + 1e-9).cast("long")
    out = cells.filter("in_context").withColumns({"grid_x_index": gx, "grid_y_index": gy, "cell_area_m2": F.lit(grid.resolution**2)})
    return out.withColumn("cell_id", F.concat_ws("_", F.lit(f"EPSG{epsg}"), F.lit(f"{res}m"), F.col("grid_x_index").cast("string"), F.col("grid_y_index").cast("string")))


def compare_shapes(spark: SparkSession, grid: GridSpec, a: list[Shape], b: list[Shape], tolerance_ha: float) -> dict[str, float | bool]:
    """Areas of two unions by cells, of what only one of them has, and whether that is within tolerance."""
    cells = core_and_buffer(spark, grid, a, 0.0, hull=False).select("row", "col", F.lit(1).alias("a"))
    other = core_and_buffer(spark, grid, b, 0.0, hull=False).select("row", "col", F.lit(1).alias("b"))
    both = cells.join(other, ["row", "col"], "full")
    one, two, only = both.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count_if(F.col("a").isNull() | F.col("b").isNull())).first()
    ha = grid.resolution**2 / 10_000
    return {"first_ha": one * ha, "second_ha": two * ha, "difference_ha": only * ha, "within_tolerance": only * ha <= tolerance_ha}


def normalise_text(value: Any) -> str:
    """NFKD without combining marks, case-folded and trimmed."""
    return "".join(c for c in unicodedata.normalize("NFKD", str(value)) if not unicodedata.combining(c)).casefold().strip()


def select_units(features: list[tuple[dict[str, Any], Shape | None]], names: list[str], codes: list[str] = (), name_field: str = "name", code_field: str = "pcode", parent: tuple[str, str] | None = None) -> list[tuple[dict[str, Any], Shape | None]]:
    """Units by code, else by normalised name; each must be found once, and lie in the parent if one is given."""
    field, wanted, same = (code_field, list(codes), str) if codes else (name_field, [normalise_text(n) for n in names], normalise_text)
    out = []
    for w in wanted:
        found = [f for f in features if same(f[0].get(field, "")) == w]
        if len(found) != 1:
            raise ValueError(f"{w} is there {len(found)} times")
        out += found
    if parent and any(normalise_text(p.get(parent[0], "")) != normalise_text(parent[1]) for p, _ in out):
        raise ValueError(f"a unit isn't in {parent[1]}")
    return out


def clip_and_annotate(df: DataFrame, shape: Shape, constants: dict[str, str], x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Features whose point lies inside, with constant columns of provenance. The box is a filter that
    reaches the scan; only what is left goes through the rings."""
    x1, y1, x2, y2 = shape.bounds()
    near = df.filter(F.col(x).between(x1, x2) & F.col(y).between(y1, y2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[shape.contains(pdf[x].to_numpy(float), pdf[y].to_numpy(float))]

    return near.mapInPandas(run, near.schema).withColumns({k: F.lit(v) for k, v in constants.items()})


def filter_classes(df: DataFrame, field: str, classes: list[str]) -> DataFrame:
    """Rows of the classes; a missing column raises."""
    if field not in df.columns:
        raise ValueError(f"no column {field}")
    return df.filter(F.col(field).isin(list(classes)))


def layer_profile(features: list[tuple[dict[str, Any], Shape | None]], search: str = "") -> dict[str, Any]:
    """Counts of a layer's features, its bounds, and the names that hold the searched text."""
    shapes = [s for _, s in features]
    some = [s for s in shapes if s is not None and s.rings]
    boxes = [s.bounds() for s in some]
    names = sorted({str(v) for p, _ in features for v in p.values() if isinstance(v, str) and normalise_text(search) in normalise_text(v)}) if search else []
    return {
        "features": len(shapes), "null": sum(s is None for s in shapes), "empty": sum(s is not None and not s.rings for s in shapes), "invalid": sum(bool(s.faults()) for s in some),
        "duplicates": len(some) - len({s.rings for s in some}), "bounds": [f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max))] if boxes else None, "names": names,
    }


def grid_rectangle(grid: GridSpec, inset: float = 0.0) -> Shape:
    """The grid's outline, inset by a share of a pixel."""
    d = inset * grid.resolution
    x1, x2 = grid.xmin + d, grid.xmin + grid.width * grid.resolution - d
    y1, y2 = grid.ymax - grid.height * grid.resolution + d, grid.ymax - d
    return Shape.of([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])


def buffered_extent(shape: Shape, buffer_m: float, resolution: float, anchor: tuple[float, float]) -> tuple[float, float, float, float]:
    """The hull's box with the buffer around, snapped outwards to the anchored grid."""
    x1, y1, x2, y2 = shape.hull().bounds()
    down = lambda v, a: math.floor((v - buffer_m - a) / resolution) * resolution + a
    up = lambda v, a: math.ceil((v + buffer_m - a) / resolution) * resolution + a
    return down(x1, anchor[0]), down(y1, anchor[1]), up(x2, anchor[0]), up(y2, anchor[1])
