"""The given tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.functions.columns import let
from litvec.operators.pooling import pool
from litvec.runtime import spread

DIM = 64
BODY = ("abstract", "intro", "methods", "results", "discuss", "concl")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _passages(lines: Column) -> Column:
    """Lines as passages: the first is the title, the last of many the references, the rest six body parts."""

    def passage(line: Column, i: Column) -> Column:
        n = F.size(lines)
        section = (
            F.when((n > 1) & (i == 0), "title")
            .when((n > 8) & (i == n - 1), "ref")
            .otherwise(F.element_at(F.array(*map(F.lit, BODY)), (F.floor(6 * i / n) + 1).cast("int")))
        )
        infons = F.create_map(
            F.lit("type"), F.concat(section, F.lit(" ")), F.lit("section_type"), F.concat(F.lit(" "), F.upper(section))
        )
        return F.struct(infons.alias("infons"), line.alias("text"))

    return F.transform(lines, passage)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as nested documents; those in English have a full-text id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.when(F.col("lang") == "en", F.concat(F.lit("PMC"), F.col("doc_id"))).alias("pmcid"),
        F.date_add(F.lit("2015-01-01").cast("date"), F.col("n_chars").cast("int")).cast("string").alias("date"),
        F.array(F.concat(F.lit("A. "), "source"), F.concat(F.lit("B. "), "lang")).alias("authors"),
        F.col("source").alias("journal"),
        let(F.split("text", "\n"), _passages).alias("passages"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a corpus."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as token vectors of one text per label, masked where the first value is negative."""
    return table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding").alias("vec"), (F.col("embedding")[0] >= 0).cast("int").alias("mask")
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    every = token_vectors(spark, sf_dir).withColumn("mask", F.lit(1))
    return pool(every, "label", pooling="mean_pooling").select(
        F.col("label").cast("long").alias("query_id"), F.col("vec").alias("vector")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the text of the document of the same number as metadata."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("pmid"), "text", F.col("lang").alias("section")
    )
    return vectors(spark, sf_dir).join(texts, "id")
