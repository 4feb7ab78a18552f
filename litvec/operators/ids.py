"""Consecutive numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litvec.runtime import small_side, stage

# monotonically_increasing_id() holds the partition in the upper bits and the row in the lower 33.
_ROW_BITS = (1 << 33) - 1


def dense_ids(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Number the rows 0..n-1 in the given order, which must be unique.

    Rows are range partitioned by the whole order, so one hot leading key spreads over many
    tasks, and numbered inside their partition. The staged rows are then shifted by the row
    counts of the partitions before theirs, a table with one row per partition.

    Without an order the rows are numbered as they lie, and nothing is shuffled.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = df.withColumns(
        {
            "_partition": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
        }
    )
    staged = stage(numbered, "dense-ids")
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_partition")
        .agg(F.count("*").alias("_n"))
        .select("_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return staged.join(F.broadcast(offsets), "_partition").select(
        (F.col("_row") + F.col("_offset")).alias(name), *df.columns
    )


def label_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Distinct labels in ascending order with their codes 0..k-1."""
    return dense_ids(df.where(F.col(label).isNotNull()).select(label).distinct(), label, name=code)


def encode_labels(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Add the code of each label."""
    return df.join(small_side(label_codes(df, label, code), "codes"), label, "left")


def decode_labels(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Put the labels back: the inverse of ``encode_labels``."""
    return df.join(small_side(codes, "codes"), code, "left")
