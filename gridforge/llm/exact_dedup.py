"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts by their leading bytes and a hash, Spark's
external sort puts equal texts side by side, and a window compares neighbours' whole texts. The
window's keys begin with the range's keys, so sorting and comparing take one exchange. The salt is 0 except for texts that a
sample shows to fill more than a quarter of a partition (at most 4 x partitions of them): their rows
are dealt out by document, and what their parts have in common is added up before any shuffle and
joined back by digest from a broadcast of at most that many short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import pick, shards_of

#: Characters of a text that splitters are made of.
HEAD = 32
#: White space runs that are not one plain space already; each becomes one space.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _ranked(docs: DataFrame, whole: bool) -> DataFrame:
    """docs (doc_id, text and more) with norm, salt, place, keep_id and group_size of the salt's part of each
    group, and all_id and all_size where a text is dealt out. With ``whole`` text travels, else norm."""
    n, _ = shards_of(docs)
    rows = docs.count()
    hashed = lambda frame: frame.select(F.xxhash64(_normal(F.col("text"))).alias("h"))
    # a hundred sampled rows of a text that is just hot, on the average
    share = min(1.0, 400.0 * n / max(rows, 1))
    sample = hashed(docs if share == 1.0 else docs.sample(share, seed=7)).groupBy("h").count()
    hot = [r.h for r in sample.filter(F.col("count") > F.lit(max(8.0, 0.75 * share * rows / (4 * n)))).orderBy(F.desc("count")).limit(4 * n).collect()]

    # splitters are sampled from the leading bytes, the hash and the salt, so the driver sees a few
    # dozen bytes of a sampled row; the whole text decides within the partition
    keys = ["head", "h", "salt"]
    spread = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.lit(-1)) if hot else F.lit(-1)
    dealt = docs.withColumn("norm", _normal(F.col("text"))).withColumn("h", F.xxhash64("norm"))
    dealt = dealt.withColumns({"head": F.substring("norm", 1, HEAD), "salt": spread}).drop("norm" if whole else "text")
    if not hot:  # a constant would vanish from the range
        keys = keys[:2]
    same = Window.partitionBy(*keys, "norm")
    dealt = dealt.repartitionByRange(n, *keys)
    if whole:
        dealt = dealt.withColumn("norm", _normal(F.col("text")))
    inside = dealt.withColumns({"place": F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())), "keep_id": F.min("doc_id").over(same), "group_size": F.count("*").over(same)})
    if not hot:
        return inside
    merged = docs.select("doc_id", _normal(F.col("text")).alias("norm")).filter(F.xxhash64("norm").isin(hot)).groupBy("norm").agg(F.min("doc_id").alias("all_id"), F.count("*").alias("all_size"))
    # two texts of one hash are two rows here; more than 4 x partitions rows would take hash collisions
    merged = merged.select(F.sha2("norm", 256).alias("digest"), "all_id", "all_size")
    inside = inside.join(F.broadcast(merged), (F.col("salt") >= 0) & (F.sha2("norm", 256) == F.col("digest")), "left").drop("digest")
    found = lambda name, own: F.when(F.col("salt") >= 0, F.col(name)).otherwise(F.col(own))
    return inside.withColumns({"keep_id": found("all_id", "keep_id"), "group_size": found("all_size", "group_size")}).drop("all_id", "all_size")


def _kept() -> Column:
    """Of the rows that agree in text and have its smallest doc_id exactly one; such rows are dealt out together."""
    return (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null
    counts as empty, so null and empty texts are one group. The row with the smallest doc_id stays,
    a null doc_id being larger than any; of rows that agree in doc_id too, exactly one. keep_id is
    null only where all doc_ids of a group are. Texts may be of any length. An empty table gives an
    empty result. Only the two named columns are read.
    """
    ranked = _ranked(pick(df, id_column, text_column).toDF("doc_id", "text"), False)
    return ranked.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), _kept().alias("kept"), F.sha2("norm", 256).alias("text_sha256"))


def first_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with all columns and as they are. They travel once and nothing is joined."""
    names = [f"c{k}" for k in range(len(df.columns))]
    low = [c.lower() for c in df.columns]
    at = lambda name: names[df.columns.index(name) if name in df.columns else low.index(name.lower())]
    ranked = _ranked(df.toDF(*names).withColumnsRenamed({at(id_column): "doc_id", at(text_column): "text"}), True)
    order = ["doc_id" if n == at(id_column) else "text" if n == at(text_column) else n for n in names]
    return ranked.filter(_kept()).select(*order).toDF(*df.columns)
