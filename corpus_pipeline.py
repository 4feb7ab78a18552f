"""Documents to packed sequences: toxic texts, copies, near copies and benchmark passages go, the rest is packed.

Every stage reads whole texts and works on all that its predecessor kept. Clean documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litvec.llm import decontaminate, exact, near, sequences, toxicity
from litvec.llm.common import table
from litvec.llm.queries import vocabulary
from litvec.runtime import spread, stage


# Bytes of an Arrow batch: workers live on from stage to stage, and both sides hold a batch for each running task.
BATCH_BYTES = "4m"


def bounded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` on all cores; from here on the session hands batches of bounded bytes to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spread(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from ``labels`` and the documents; a score of 0.7 or more rejects."""
    return toxicity.drop_toxic(bounded(spark, docs), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(bounded(spark, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_duplicates(bounded(spark, docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(bounded(spark, docs), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sequences.digests(sequences.pack(bounded(spark, docs.select("doc_id", "text")), vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# No SQL says what a trained model, sketches or a tokenizer do; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
