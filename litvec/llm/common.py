"""What several of these operators need: tables, links to classes, columns kept apart from those of the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.runtime import small_side, stage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def components(links: DataFrame) -> DataFrame:
    """Classes of linked ids: rows of ``id`` and ``class_id``, the smallest id that links lead to.

    ``links`` has the columns ``a`` and ``b``; null ends and links to itself are left out. In every
    round an id takes the smallest label among its own and its neighbours', and then the label of
    that label, so chains shorten by doubling. A round is written to the shared folder before the next
    one reads it; only whether labels changed comes to the driver. An empty table gives none.
    """
    own = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")]))
    edges = stage(own.select(both), "edges")
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = small_side(labels, "labels")
        own_label = labels.select("id", F.col("label").alias("near"), F.col("label").alias("was"))
        neighbours = edges.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b")
        neighbours = neighbours.select(F.col("a").alias("id"), "near", F.lit(None).cast("long").alias("was"))
        lowest = own_label.union(neighbours).groupBy("id").agg(F.min("near").alias("near"), F.max("was").alias("was"))
        above = labels.select(F.col("id").alias("near"), F.col("label").alias("label"))
        following = stage(lowest.join(above, "near").select("id", "label", "was"), "labels")
        labels = following.select("id", "label")
        if following.where("label <> was").isEmpty():
            return labels.select("id", F.col("label").alias("class_id"))


def without(df: DataFrame, listed: DataFrame, doc_id: str, digest: Column) -> DataFrame:
    """The rows of ``df`` that a staged list ``id, digest, stays`` does not name, and one of each that is to stay.

    ``digest`` is what the list calls ``digest`` of a row, so an id may repeat, be null or stand for several texts. The
    list is counted and weighed: it is broadcast, so that rows pass in the task that reads them, or beyond that joined
    by shuffle. Rows that stay although they are listed repeat others; only these are grouped, in map tasks first.
    """
    own = df.select(F.struct("*").alias("own"), F.col(doc_id).alias("doc_id"), digest.alias("own_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    left = own.join(small_side(listed.select("id", "digest"), "listed"), same, "left_anti").select("own")
    stays = listed.where("stays")
    if not stays.isEmpty():
        repeated = own.join(small_side(stays.select("id", "digest"), "stays"), same)
        left = left.union(repeated.groupBy("id", "digest").agg(F.first("own").alias("own")).select("own"))
    return left.select(*[F.col("own").getField(c).alias(c) for c in df.columns])
