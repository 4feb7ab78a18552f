"""One row per text, one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_text(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of all rows that agree in ``keys`` (long texts allowed) keep the one lowest in ``order``.

    A null order comes last, ties go to the smaller digest of the row, and of rows that agree in
    every column one stays. Only digests and order values are grouped and shuffled, already
    reduced in every map task, so a text with billions of copies is no heavier than another;
    whole rows move once, to be matched with the winners.
    """
    digests = [F.sha2(F.col(k).cast("string"), 256) for k in keys]
    rest = [c for c in df.columns if c not in keys]
    known = [F.coalesce(d, F.lit("null")) for d in digests]
    row = F.concat_ws("/", *known, F.sha2(F.to_json(F.struct(*rest)), 256) if rest else F.lit(""))
    marked = df.withColumn("_row", row)
    first = F.min(F.struct(F.col(order).isNull().alias("unordered"), F.col(order).alias("order"), "_row"))
    winners = marked.groupBy(*[d.alias(f"_digest{i}") for i, d in enumerate(digests)]).agg(first.alias("w"))
    kept = marked.join(winners.select("w._row"), "_row", "left_semi")
    return kept.groupBy("_row").agg(*[F.first(c).alias(c) for c in df.columns]).drop("_row")


def latest_per_id(df: DataFrame, doc_id: str, position: str) -> DataFrame:
    """One row per id: the values of its last position, placed at its first position.

    Reduced in every map task before the shuffle, so a much repeated id needs no large group.
    """
    rest = [c for c in df.columns if c not in (doc_id, position)]
    return (
        df.groupBy(doc_id)
        .agg(
            F.min(position).alias(position),
            F.max_by(F.struct(*rest), position).alias("last"),
        )
        .select(doc_id, position, "last.*")
    )
