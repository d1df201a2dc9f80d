"""Readers and writers: manifests, sharded tables, checkpoints and guarded releases."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_manifest(spark: SparkSession, path: str, schema: StructType | str, required: list[str], state: str | None = "state") -> DataFrame:
    """A CSV manifest: empty strings stay empty, states are upper-cased, anything but PASS raises."""
    df = spark.read.csv(path, header=True, schema=schema, nullValue="\u0000", emptyValue="").fillna("")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    if state:
        df = df.withColumn(state, F.upper(state))
        if not df.filter(F.coalesce(F.col(state) != "PASS", F.lit(True))).isEmpty():
            raise ValueError(f"{path} has rows that did not pass")
    return df


def read_shards(spark: SparkSession, pattern: str, schema: StructType, columns: list[str]) -> DataFrame:
    """All CSV shards of a pattern, in the contract's column order."""
    return spark.read.csv(pattern, header=True, schema=schema, enforceSchema=False).select(*columns)


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the needed columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def read_within(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Features whose bounding box meets the box; the comparisons reach Parquet's row groups."""
    x1, y1, x2, y2 = box
    return spark.read.parquet(path).filter((F.col("xmin") <= x2) & (F.col("xmax") >= x1) & (F.col("ymin") <= y2) & (F.col("ymax") >= y1))


def write_release(df: DataFrame, path: str, partition: str, version: dict, protected: bool = True) -> None:
    """Parquet by partition with a version row beside it; a protected release is never overwritten."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_version")
    if protected and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(f"{path} is released")
    store, jvm = place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs
    beside = f"{path}/.data-{uuid.uuid4().hex}"
    df.write.partitionBy(partition).parquet(beside)  # a broken write leaves the release as it was
    store.delete(jvm.Path(f"{path}/data"), True)
    if not store.rename(jvm.Path(beside), jvm.Path(f"{path}/data")):
        raise OSError(f"{path}/data couldn't be put in place")
    spark.createDataFrame([(stable_hash(version), json.dumps(version, sort_keys=True, default=str))], "sha256 string, version string").coalesce(1).write.mode("overwrite").json(f"{path}/_version")


def stable_hash(value) -> str:
    """sha256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, sha256) of files, hashed by the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def load_json(path: str) -> dict:
    got = json.loads(Path(path).read_text())
    if not isinstance(got, dict):
        raise ValueError(f"{path} is no object")
    return got
