"""Joins whose hot keys are known, and connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Folder


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], most: int) -> DataFrame:
    """big joined with small, which has one row for each key and in ``many`` how many rows of big have it.

    Keys with more than ``most`` rows of big would each fill a task. There are fewer of them than big's
    rows / most (4 x shards by hot_limit), so their rows come to the driver and are broadcast; the others
    are joined by a shuffle without these, and alone if there are none.
    """
    names = [c for c in small.columns if c != "many"]
    rows = small.filter(F.col("many") > most).select(*names).collect()
    small = small.select(*names)
    if not rows:
        return big.join(small, keys)
    hot = F.broadcast(big.sparkSession.createDataFrame(rows, small.schema))
    cold = big.join(hot.select(*keys), keys, "left_anti").join(small.join(hot.select(*keys), keys, "left_anti"), keys)
    return big.join(hot, keys).select(*cold.columns).unionByName(cold)


def hot_limit(rows: int, shards: int) -> int:
    """More rows of a key than this fill a quarter of a task's share; fewer than 4 x shards keys have so many."""
    return max(64, rows // (4 * shards))


def components(edges: DataFrame, folder: Folder, name: str, shards: int) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b) that aren't roots; a root is its component's least node.

    Every step groups by node with map-side minima and joins the minima back; nodes with more than a
    quarter of a task's share of edges get theirs by broadcast, the others by a shuffle, so no task
    gathers a hub. Steps are written to the shared folder, which cuts lineage, and removed when the
    next one is there; it ends when a step changes nothing.
    """
    spark = edges.sparkSession
    now = folder.save(_down(edges.select(F.col("a").alias("v"), F.col("b").alias("m"))), f"{name}-0")
    state, step = _state(now), 0
    while state[0]:
        most = hot_limit(2 * state[0], shards)
        step += 1
        now = folder.save(_small(_large(now, most), most), f"{name}-{step}")
        folder.drop(spark, f"{name}-{step - 1}")
        gc.collect()
        spark._jvm.System.gc()  # a step's plans and broadcasts are of no use to the next one
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("v").alias("node"), F.col("m").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64("m", "v"), F.lit(1 << 31)))).first())


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return edges.filter("v <> m").select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct()


def _large(edges: DataFrame, most: int) -> DataFrame:
    """Larger neighbours of each node are tied to the least of its neighbourhood."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.min("w").alias("low"), F.count("*").alias("many")).select("u", F.least("u", "low").alias("low"), "many")
    return _down(join_counted(both.filter("w > u"), least, ["u"], most).select(F.col("w").alias("v"), F.col("low").alias("m")))


def _small(edges: DataFrame, most: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("v").agg(F.min("m").alias("low"), F.count("*").alias("many"))
    tied = join_counted(edges, least, ["v"], most).select(F.col("m").alias("v"), F.col("low").alias("m"))
    return _down(tied.unionByName(least.select("v", F.col("low").alias("m"))))
