"""Writers of metadata and small outputs on the driver, and of checkpoints that a run can go on from.

A file is written whole under another name and then renamed, so a broken run never leaves half of one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.vector import Shape
from .tables import stable_hash


def write_text(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def write_json(path: str | Path, content: Any) -> None:
    write_text(path, json.dumps(content, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def write_yaml(path: str | Path, content: Any) -> None:
    import yaml

    write_text(path, yaml.safe_dump(content, sort_keys=False, allow_unicode=True))


def write_shapes(path: str | Path, features: Iterable[tuple[dict[str, Any], Shape | None]], crs: str) -> None:
    """One GeoJSON layer in place of what was there."""
    write_json(path, {"type": "FeatureCollection", "crs": crs, "features": [{"type": "Feature", "properties": p, "geometry": s.to_geojson() if s and s.rings else None} for p, s in features]})


def write_mask(df: DataFrame, path: str, column: str, by: str = "row", buckets: int = 64) -> None:
    """A 0/1 band as Parquet, cells in order within bands of rows; another value raises before anything is written."""
    if not df.filter(~F.coalesce(F.col(column).isin(0, 1), F.lit(False))).isEmpty():
        raise ValueError(f"{column} must be 0 or 1")
    out = df.select("row", "col", F.col(column).cast("byte").alias(column)).withColumn("band", F.pmod(F.col(by), F.lit(buckets)).cast("int"))
    out.repartition("band").sortWithinPartitions("row", "col").write.mode("overwrite").option("compression", "zstd").partitionBy("band").parquet(path)


def resumable(items: list, path: str, config: Any, schema: StructType | str, step: Callable[[Any], list[tuple]], key: Callable[[Any], str] = str) -> list[tuple]:
    """step(item) of every item, each result written at once, so that a run can go on where it was broken.

    Beside the results stands the hash of the configuration; to go on under another one raises.
    """
    folder, print_ = Path(path), stable_hash(config)
    mark = folder / "configuration.json"
    if mark.exists() and json.loads(mark.read_text())["sha256"] != print_:
        raise ValueError(f"{path} was begun under another configuration")
    write_json(mark, {"sha256": print_})
    out: list[tuple] = []
    for item in items:
        done = folder / f"{stable_hash(key(item))}.json"
        if not done.exists():
            write_json(done, {"key": key(item), "rows": [list(r) for r in step(item)]})
        out += [tuple(r) for r in json.loads(done.read_text())["rows"]]
    return out


def read_checkpoint(spark: SparkSession, path: str, schema: StructType, flags: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """A partial CSV: dates that can't be read are null, flags are true for the text 'true' in any case, else false."""
    texts = StructType([f if f.name not in (*flags, *dates) else type(f)(f.name, spark.range(0).select(F.lit("").alias("x")).schema[0].dataType) for f in schema.fields])
    df = spark.read.csv(path, header=True, schema=texts)
    df = df.withColumns({c: F.coalesce(F.lower(F.trim(F.col(c))) == "true", F.lit(False)) for c in flags})
    return df.withColumns({c: F.try_to_timestamp(F.col(c)).cast("date") for c in dates})


def write_manual_template(samples: DataFrame, path: str, columns: list[str], label: str = "manual_label") -> None:
    """The samples to be labelled, without predictions, in order of id; a file that holds labels isn't overwritten.

    Samples are bounded by the design's targets, so they are one CSV file.
    """
    import csv

    if Path(path).exists():
        with open(path, newline="", encoding="utf-8") as file:
            if any((r.get(label) or "").strip() for r in csv.DictReader(file)):
                raise FileExistsError(f"{path} holds labels")
    rows = samples.select(*columns).orderBy("sample_id").toPandas()
    rows[label] = ""
    write_text(path, rows.to_csv(index=False))


def write_outputs(spark: SparkSession, folder: str, tables: dict[str, DataFrame], protocol: dict[str, Any], config: Any) -> dict[str, str]:
    """Every table as Parquet and CSV, the protocol as YAML, and a version file with the hash of each
    table's rows. Hashes are sums over row hashes, so they don't depend on order."""
    hashes = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        saved = spark.read.parquet(f"{folder}/{name}.parquet")
        saved.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
        hashes[name] = str(saved.agg(F.coalesce(F.sum(F.xxhash64(*saved.columns).cast("decimal(38,0)")), F.lit(0))).first()[0])
    write_yaml(f"{folder}/protocol.yaml", protocol)
    write_json(f"{folder}/version.json", {"configuration_sha256": stable_hash(config), "tables": hashes})
    return hashes


def write_threshold_metadata(folder: str, thresholds: DataFrame, areas: DataFrame, recipe: dict[str, Any]) -> tuple[str, str]:
    """Sorted threshold and area tables (a row an epoch and index) and the recipe; (hash of thresholds, of recipe)."""
    rows = [r.asDict() for r in thresholds.orderBy("epoch", "index_name").collect()]
    write_json(f"{folder}/threshold_table.json", [{**r, "threshold_record_sha256": stable_hash(r)} for r in rows])
    write_json(f"{folder}/area_summary.json", [r.asDict() for r in areas.orderBy("epoch", "index_name").collect()])
    write_json(f"{folder}/recipe.json", recipe)
    return stable_hash(rows), stable_hash(recipe)


def write_report(path: str | Path, title: str, sections: dict[str, DataFrame | str]) -> None:
    """A Markdown report of small tables (a row an epoch or model) and text."""
    lines = [f"# {title}", ""]
    for name, body in sections.items():
        lines += [f"## {name}", ""]
        if isinstance(body, str):
            lines += [body, ""]
            continue
        lines += ["| " + " | ".join(body.columns) + " |", "|" + " --- |" * len(body.columns)]
        lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in body.collect()]
        lines.append("")
    write_text(path, "\n".join(lines))


def write_grid_linkage(folder: str, grid: Any, layers: list[dict[str, Any]]) -> None:
    """How auxiliary layers (name, source, resolution_m, year) lie on the grid."""
    for layer in layers:
        missing = [k for k in ("name", "source", "resolution_m") if k not in layer]
        if missing:
            raise ValueError(f"a layer lacks {missing}")
    write_yaml(f"{folder}/grid_linkage.yaml", {"grid": vars(grid), "layers": [{**x, "cells_a_pixel": (float(x["resolution_m"]) / grid.resolution) ** 2} for x in layers]})


def save_state(path: str | Path, arrays: dict[str, np.ndarray], settings: dict[str, Any]) -> None:
    """Fitted arrays and settings as one file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    with open(part, "wb") as file:
        np.savez(file, **arrays, settings=np.array(json.dumps(settings, sort_keys=True)))
    os.replace(part, path)


def load_state(path: str | Path) -> tuple[dict[str, np.ndarray], dict[str, Any]]:
    with np.load(path) as got:
        return {k: got[k] for k in got.files if k != "settings"}, json.loads(str(got["settings"]))


def provenance(paths: dict[str, str], spark: SparkSession) -> DataFrame:
    """name, path, sha256, status of the files that a run depends on; a missing one is MISSING."""
    from .tables import file_hashes

    there = {n: p for n, p in paths.items() if Path(p).is_file()}
    known = {r.path.removeprefix("file:"): r.sha256 for n in there for r in file_hashes(spark, there[n]).collect()}
    rows = [(n, p, known.get(str(Path(p).resolve())), "PASS" if n in there else "MISSING") for n, p in paths.items()]
    return spark.createDataFrame(rows, "name string, path string, sha256 string, status string")


def preflight(checks: dict[str, Callable[[], Any]]) -> dict[str, str]:
    """Every check's outcome; a stage may start only if all are PASS, else RuntimeError names the failures."""
    out = {}
    for name, check in checks.items():
        try:
            out[name] = "PASS" if check() in (None, True) else "FAIL"
        except (ValueError, KeyError, FileNotFoundError, RuntimeError) as fault:
            out[name] = f"FAIL: {fault}"
    failed = {k: v for k, v in out.items() if v != "PASS"}
    if failed:
        raise RuntimeError(f"preflight: {failed}")
    return out


def write_preflight(path: str | Path, config: dict[str, Any], dataset: DataFrame, folds: list[dict[str, Any]]) -> dict[str, Any]:
    """Hashes of configuration and schema, the folds, and that the final test is locked."""
    from .config import check_lock

    check_lock(config)
    content = {"configuration_sha256": stable_hash(config), "schema_sha256": stable_hash(dataset.schema.json()), "rows": dataset.count(), "folds": folds, "final_test_locked": True}
    write_json(path, content)
    return content
