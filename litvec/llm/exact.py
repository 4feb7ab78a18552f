"""Exact duplicates by recipes: ordered lists of identifiers of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty, without
from litvec.runtime import stage

# A chunk ends behind a letter of the first class and one of the second (code points 1 and 5 modulo 8),
# so an edit moves the borders near it only. Shortest and longest chunk in characters.
MARK = r"(?<=[aiqyAIQY19][emuEMU5-])"
SHORTEST, LONGEST = 1024, 16384
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The whole text cut at content-defined borders; an empty text has no chunk."""
    pattern = rf"(?s).{{{shortest},{longest}}}?{MARK}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A staged row per row of ``df``: ``row``, ``doc_id``, ``text_sha256`` and the chunks' ``keys`` and ``proofs``.

    A key is a 64-bit hash, its proof the SHA-256 digest of the chunk. The texts stay behind.
    """
    cut = df.select(
        F.col(doc_id).alias("doc_id"),
        normalised(text_or_empty(text)).alias("normal"),
    ).select("doc_id", F.sha2("normal", 256).alias("text_sha256"), chunks(F.col("normal")).alias("chunks"))
    return stage(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text_sha256",
            F.transform("chunks", lambda c: F.xxhash64(c)).alias("keys"),
            F.transform("chunks", lambda c: F.sha2(c, 256)).alias("proofs"),
        ),
        "recipes",
    )


def chunk_store(rows: DataFrame) -> DataFrame:
    """Every distinct chunk once: ``key``, ``proof`` and its number of ``copies``."""
    return (
        rows.select(F.explode(F.arrays_zip("keys", "proofs")).alias("c"))
        .groupBy(F.col("c.keys").alias("key"), F.col("c.proofs").alias("proof"))
        .agg(F.count("*").alias("copies"))
    )


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids``, the ordered list of verified identifiers.

    The key identifies a chunk as long as the store knows one proof for it. Rows with a chunk
    whose key stands for several proofs are listed by proofs instead.
    """
    shared = chunk_store(rows).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    unsafe = (
        rows.select("text_sha256", F.explode("keys").alias("key"))
        .join(stage(shared, "shared-keys"), "key", "left_semi")
        .select(F.col("text_sha256").alias("unsafe"))
        .distinct()
    )
    by_key = F.transform("keys", lambda k: k.cast("string"))
    return rows.join(stage(unsafe, "unsafe"), F.col("text_sha256") == F.col("unsafe"), "left").select(
        "row", "doc_id", "text_sha256", F.when(F.col("unsafe").isNull(), by_key).otherwise(F.col("proofs")).alias("ids")
    )


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they agree after every run of white space became one space; a null text
    counts as empty. Of equal texts the row with the smallest id stays, ids before null; of rows
    that repeat an id and its text one stays. ``keep_id`` is the id of that row. An empty table
    gives an empty one, and other columns of ``df`` are not looked at.

    A long text is read once; what moves afterwards are its digest and its identifiers. Groups
    are counted in every map task before the shuffle, and only texts with several rows are joined
    back, so neither a hot text nor a hot chunk gathers in one task.
    """
    listed = stage(identified(recipes(df, doc_id, text)), "recipes-by-id")
    groups = (
        listed.groupBy("ids")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"),
            F.count("*").alias("size"),
        )
        .where("size > 1")
    )
    groups = stage(groups.withColumnRenamed("ids", "group_ids"), "groups")
    return listed.join(groups, F.col("ids") == F.col("group_ids"), "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of equal texts, with all columns of ``df``: the row that ``exact_duplicates`` keeps.

    Rows are told apart by id and text, so an id may repeat, be null or stand for several texts. Of
    rows that repeat both, one stays; if they differ in other columns, any of them. Only those rows
    are grouped, in map tasks first; all others pass by an anti-join.
    """
    judged = exact_duplicates(df, doc_id, text).groupBy("doc_id", "text_sha256")
    judged = judged.agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    listed = stage(judged.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "stays"), "listed")
    return without(df, listed, doc_id, F.sha2(normalised(text_or_empty(text)), 256))
