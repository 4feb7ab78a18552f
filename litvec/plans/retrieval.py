"""Questions to hits and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.operators import prompts
from litvec.operators.search import DEMO_K, knn
from litvec.plans.corpus import Embedder
from litvec.sources import collections

# Fixed value: fields returned with a hit; those the corpus lacks are left out.
HIT_FIELDS = ("text", "pmid", "section", "sentence")


def search_texts(
    corpus: DataFrame,
    questions: DataFrame,
    embedder: Embedder,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
    fields: Sequence[str] = HIT_FIELDS,
) -> DataFrame:
    """Hits of every question ``(query_id, text)``, embedded by the embedder of the corpus."""
    return knn(corpus, embedder(questions), k, metric, where, fields)


def retrieve_and_prompt(
    corpus: DataFrame,
    questions: DataFrame,
    embedder: Embedder,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
) -> DataFrame:
    """One prompt per question with its cited context."""
    return prompts.messages(questions, search_texts(corpus, questions, embedder, k, metric, where))


def search_collection(
    spark: SparkSession,
    namespace: str,
    name: str,
    questions: DataFrame,
    embedder: Embedder,
    k: int = DEMO_K,
    where: Column | str | None = None,
    fields: Sequence[str] = HIT_FIELDS,
) -> DataFrame:
    """Hits of every question in a stored collection, by the metric that it was written with.

    A missing collection raises; a question vector of another dimension fails the job.
    """
    stored = collections.open_collection(spark, namespace, name)
    kept = collections.properties(spark, namespace, name)
    asked = embedder(questions)
    size = F.size("vector")
    wrong = F.raise_error(F.format_string(f"collection of dimension {kept['dimension']}, question of %d", size))
    checked = F.when(F.col("vector").isNull() | (size == int(kept["dimension"])), F.col("vector")).otherwise(wrong)
    return knn(stored, asked.withColumn("vector", checked), k, kept["metric"], where, fields)


def prompt_from_collection(
    spark: SparkSession,
    namespace: str,
    name: str,
    questions: DataFrame,
    embedder: Embedder,
    k: int = DEMO_K,
    where: Column | str | None = None,
) -> DataFrame:
    """One prompt per question with its cited context from a stored collection."""
    hits = search_collection(spark, namespace, name, questions, embedder, k, where)
    return prompts.messages(questions, hits)
