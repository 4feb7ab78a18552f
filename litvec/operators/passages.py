"""Documents to passages, and the cleaning and grouping of passage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.functions import text as tx

# The sections kept by default, and the preset that takes the title and not the conclusion.
DEFAULT_SECTIONS = ("abstract", "intro", "results", "discuss", "methods", "concl")
TITLE_SECTIONS = ("title", "abstract", "intro", "results", "discuss", "methods")
# A passage must have more words than this; text put in the place of nulls.
MIN_WORDS = 5
UNKNOWN = "Unknown"

# Positions that are joined first; the joined parts of a longer group are joined in their turn.
PART_SIZE = 4096


def section_of(pmcid: Column, infons: Column) -> Column:
    """Section name of a passage: ``type`` for abstract-only records, ``section_type`` for full texts."""
    return F.when(pmcid.isNull(), infons["type"]).otherwise(infons["section_type"])


def flatten(documents: DataFrame) -> DataFrame:
    """One row per passage with its position and the metadata of its document. No shuffle."""
    own = [F.col(c) for c in documents.columns if c not in ("pmid", "pmcid", "date", "authors", "journal", "passages")]
    return documents.select(
        *own, "pmid", "pmcid", "date", "authors", "journal", F.posexplode("passages").alias("index", "p")
    ).select(
        *own,
        F.col("index").cast("long").alias("index"),
        section_of(F.col("pmcid"), F.col("p.infons")).alias("section"),
        F.col("p.text").alias("sentence"),
        F.col("pmid").cast("string").alias("pmid"),
        "pmcid",
        "date",
        tx.joined_authors("authors").alias("authors"),
        "journal",
    )


def clean(passages: DataFrame, end_marks: bool = True, strict_dates: bool = False) -> DataFrame:
    """Normal form of section, id, date and text; ``end_marks`` closes every passage with a mark."""
    sentence = tx.strip("sentence")
    return passages.withColumns(
        {
            "section": tx.normalise_section("section"),
            "pmid": F.col("pmid").cast("string"),
            "date": tx.parse_date("date", strict_dates),
            "sentence": tx.with_end_mark(sentence) if end_marks else sentence,
        }
    )


def keep_sections(passages: DataFrame, sections: Sequence[str] = DEFAULT_SECTIONS) -> DataFrame:
    return passages.where(F.col("section").isin(*sections))


def min_words(passages: DataFrame, text: str = "sentence", more_than: int = MIN_WORDS) -> DataFrame:
    return passages.where(tx.has_more_words_than(text, more_than))


def collapse(
    passages: DataFrame,
    keys: Sequence[str] = ("pmid",),
    section: str = "section",
    index: str = "index",
    sentence: str = "sentence",
    part_size: int = PART_SIZE,
) -> DataFrame:
    """Text of every (document, section): passages in ``index`` order joined by a blank.

    ``index`` is the position in the document. Positions are joined in parts of ``part_size``, then
    the parts, so the passages of a long document are gathered by many tasks and only its joined
    texts meet. Rows without a section are left out, null sentences are skipped. Other columns take
    the value of the first passage.
    """
    grouping = [*keys, section]
    meta = [c for c in passages.columns if c not in (*grouping, index, sentence)]

    def joined(place: str, text: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), F.col(text).alias("s"))))
        return F.array_join(F.transform(in_order, lambda p: p["s"]), " ")

    first = F.struct(F.col(index).alias("i"), *meta)
    parts = (
        passages.where(F.col(section).isNotNull())
        .groupBy(*grouping, F.floor(F.col(index) / part_size).cast("long").alias("_part"))
        .agg(
            F.when(F.count(sentence) > 0, joined(index, sentence)).alias("_text"),
            F.count("*").alias("_n"),
            F.min_by(first, index).alias("_first"),
        )
    )
    return (
        parts.groupBy(*grouping)
        .agg(
            joined("_part", "_text").alias("text"),
            F.sum("_n").alias("n_passages"),
            F.min_by("_first", F.coalesce("_part", F.lit((1 << 63) - 1))).alias("_first"),
        )
        .select(*grouping, "text", "n_passages", *[F.col("_first").getField(c).alias(c) for c in meta])
    )


def single_id_violations(passages: DataFrame, frame: str, doc_id: str) -> DataFrame:
    """Frames that hold more than one id; pairs of frame and id are reduced before they are counted."""
    return passages.groupBy(frame).agg(F.countDistinct(doc_id).alias("n_ids")).where(F.col("n_ids") > 1)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def dropped_documents(documents: DataFrame, chunks: DataFrame, doc_id: str = "pmid") -> DataFrame:
    """Documents that gave no chunk."""
    return documents.join(chunks.select(doc_id).distinct(), doc_id, "left_anti")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def fill_unknown(df: DataFrame, skip: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls become ``Unknown`` in every column, or in those named; a column that is not text is made text first."""

    def filled(field: T.StructField) -> Column:
        if columns is not None and field.name not in columns:
            return F.col(field.name)
        if field.name in skip or isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.col(field.name)
        return F.coalesce(F.col(field.name).cast("string"), F.lit(UNKNOWN)).alias(field.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
