"""Configurations, grid specifications and vector files, read on the driver: each is one small document."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime
from email.utils import parsedate_to_datetime
from pathlib import Path
from typing import Any

from ..operators.grid import GridSpec
from ..operators.vector import Shape


def load_yaml(path: str, sections: Iterable[str] = ()) -> dict[str, Any]:
    """One YAML mapping; anything else, or a missing section, raises."""
    import yaml

    content = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(content, dict):
        raise ValueError(f"{path} is not a mapping")
    missing = [s for s in sections if s not in content]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return content


def load_experiment_config(path: str, model: str | None = None, sections: Iterable[str] = ("dataset", "folds")) -> dict[str, Any]:
    """An experiment's settings. The final test is locked: final_test.evaluate must be false if it is there."""
    config = load_yaml(path, sections)
    if model is not None and config.get("model") != model:
        raise ValueError(f"{path} is for {config.get('model')}, not {model}")
    check_lock(config)
    return config


def check_lock(config: dict[str, Any]) -> None:
    if bool((config.get("final_test") or {}).get("evaluate", False)):
        raise ValueError("the final test is locked")


def load_grid(path: str) -> GridSpec:
    """The frozen grid (crs, resolution_m, transform, width, height) of a JSON file, checked."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = [k for k in ("crs", "resolution_m", "transform", "width", "height") if k not in spec]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    transform = [float(x) for x in spec["transform"]]
    if len(transform) != 6:
        raise ValueError("a transform has six values")
    if transform[0] != float(spec["resolution_m"]) or transform[4] != -transform[0] or transform[1] or transform[3]:
        raise ValueError("the transform isn't north-up at the resolution")
    return GridSpec(float(spec["resolution_m"]), int(spec["width"]), int(spec["height"]), transform[2], transform[5])


def load_shapes(path: str, one: bool = False) -> list[tuple[dict[str, Any], Shape | None]]:
    """(properties, shape) of the features of a GeoJSON file; null geometries stay null. With ``one``
    exactly one feature with a shape must be there."""
    content = json.loads(Path(path).read_text(encoding="utf-8"))
    features = content["features"] if content.get("type") == "FeatureCollection" else [content]
    out = [(f.get("properties") or {}, Shape.from_geojson(f["geometry"]) if f.get("geometry") else None) for f in features]
    if one and (len(out) != 1 or out[0][1] is None or not out[0][1].rings):
        raise ValueError(f"{path} must hold exactly one shape")
    return out


def query_rectangle(path: str) -> tuple[float, float, float, float]:
    """Smallest and largest x and y of all shapes of a file, a cheap first filter."""
    boxes = [s.bounds() for _, s in load_shapes(path) if s is not None and s.rings]
    if not boxes:
        raise ValueError(f"{path} holds no shape")
    low, high = zip(*[(b[:2], b[2:]) for b in boxes], strict=True)
    return (*map(min, zip(*low, strict=True)), *map(max, zip(*high, strict=True)))  # type: ignore[return-value]


def snapshot_date(headers: dict[str, str]) -> str:
    """The date of a source from its Last-Modified header, else the epoch's first day."""
    value = {k.lower(): v for k, v in headers.items()}.get("last-modified")
    return (parsedate_to_datetime(value) if value else datetime(1970, 1, 1)).date().isoformat()


def find_root(start: str, marker: str = "configs") -> Path:
    """The nearest folder at or above start that has the marker."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / marker).exists():
            return folder
    raise FileNotFoundError(f"no folder above {start} has {marker}")


def resolve(root: str | Path, path: str) -> Path:
    """The path, below root unless it is absolute."""
    return Path(path) if Path(path).is_absolute() else Path(root) / path


def output_folder(root: str | Path, *parts: str) -> Path:
    """A folder below root, made if need be."""
    folder = Path(root).joinpath(*parts)
    folder.mkdir(parents=True, exist_ok=True)
    return folder
