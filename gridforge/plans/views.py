"""The tables that the queries run on, as DataFrames and as the same SQL text.

cells: line items by part and supplier modulo 40, one row a cell and year; scored: line items with a
label, a probability and a chronological fold; scenes: events as catalogue rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 40

CELLS = """cells AS (
  SELECT CAST(year(l_shipdate) AS INT) AS epoch, CAST(l_partkey % 40 AS INT) AS "row", CAST(l_suppkey % 40 AS INT) AS col,
         CAST(count(*) AS BIGINT) AS obs,
         CASE WHEN sum(CAST(round(l_discount * 100) AS BIGINT)) > 6 * count(*) THEN 1 ELSE 0 END AS raw,
         CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS valid,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS p
  FROM lineitem GROUP BY 1, 2, 3)"""
BANDS = """bands AS (
  SELECT epoch, "row", col, obs, raw, valid, q / (obs * 50.0E0) AS blue, d / (obs * 10.0E0) AS green, t / (obs * 8.0E0) AS red,
         p / (obs * 100000.0E0) AS nir, (q + d) / (obs * 60.0E0) AS swir1, (d + t) / (obs * 18.0E0) AS swir2 FROM cells)"""
SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         0.02E0 + 0.96E0 * l_quantity / 50.0E0 AS p, CAST(year(l_shipdate) - 1994 AS INT) AS fold FROM lineitem)"""
SCENES = """scenes AS (
  SELECT event_id AS asset_id, CAST(1 AS INT) * CAST(year(ts) AS INT) AS epoch, CAST(month(ts) AS INT) AS "month", event_type AS sensor, CAST(ts AS DATE) AS acquired,
         value / (1 + value) AS valid_fraction, CAST(user_id % 100 AS DOUBLE) AS cloud, event_id % 7 <> 0 AS has_coverage, user_id FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundred = lambda c: F.round(F.col(c) * 100).cast("long")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("epoch"), (F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_suppkey") % SIDE).cast("int").alias("col"))
        .agg(F.count("*").alias("obs"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(hundred("l_discount")).alias("d"), F.sum(hundred("l_tax")).alias("t"), F.sum(F.round("l_extendedprice").cast("long")).alias("p"))
        .withColumns({"raw": (F.col("d") > 6 * F.col("obs")).cast("int"), "valid": (F.col("obs") >= 3).cast("int")})
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("obs")
    return cells(spark, sf_dir).select(
        "epoch", "row", "col", "obs", "raw", "valid", (F.col("q") / (n * 50.0)).alias("blue"), (F.col("d") / (n * 10.0)).alias("green"), (F.col("t") / (n * 8.0)).alias("red"),
        (F.col("p") / (n * 100000.0)).alias("nir"), ((F.col("q") + F.col("d")) / (n * 60.0)).alias("swir1"), ((F.col("d") + F.col("t")) / (n * 18.0)).alias("swir2"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.lit(0.02) + F.lit(0.96) * F.col("l_quantity") / 50.0).alias("p"), (F.year("l_shipdate") - 1994).alias("fold"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("asset_id"), F.year("ts").alias("epoch"), F.month("ts").alias("month"), F.col("event_type").alias("sensor"), F.to_date("ts").alias("acquired"), (F.col("value") / (1 + F.col("value"))).alias("valid_fraction"), (F.col("user_id") % 100).cast("double").alias("cloud"), (F.col("event_id") % 7 != 0).alias("has_coverage"), "user_id")
