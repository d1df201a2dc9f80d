"""A corpus pipeline of five stages; each takes and returns rows with the columns of documents.

STAGES are (name, function) pairs. A function gets (spark, docs, sf_dir) with what its predecessor
kept, all its decisions take effect, and its result is written before the next stage reads it.
``run`` does so in the shared folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridforge.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from gridforge.llm._frames import Folder, pick, without
from gridforge.llm.queries import part_of, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled documents of the input."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(part_of(3) != 1))
    return model.keep(pick(docs, *COLUMNS))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one without doc_id only among such; of equal doc_ids one row."""
    return exact_dedup.first_copies(pick(docs, *COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are joined by links the one with the smallest doc_id stays, as in exact_dedup_stage.

    Rows get a key of their own, written with them, so that every reader sees the same keys."""
    folder = Folder(spark)
    rows = folder.save(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = jaccard_join.jaccard_components(rows, id_column="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(first).alias("first")).select("first.row")
    return without(rows, found.select("row").join(kept, "row", "left_anti"), folder)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go."""
    return decontaminate.clean(pick(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.bpe_round_trip(docs, vocabulary(), keep=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: A learnt classifier and a vocabulary file can't be put in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    folder = Folder(spark)
    docs = pick(table(spark, sf_dir, "documents"), *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = folder.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
