"""Id lists, file listings, and the files that belong to the ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.operators.ids import dense_ids

# Fixed value: document files are named with this prefix and the id.
DOCUMENT_PREFIX = "biocjson_"


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of a headerless CSV as ``(pos, doc_id)``; order and repeats are kept.

    Ids stay text, so leading zeros survive. Blank lines are skipped.
    """
    lines = spark.read.schema("doc_id string").csv(path)
    placed = lines.select(
        "doc_id",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return dense_ids(placed, "file", "block", "line", name="pos").select("pos", "doc_id")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _selected(name: Column, identifiers: Sequence[str], exclude: Sequence[str]) -> Column:
    wanted = F.lit(True)
    for part in identifiers:
        wanted = wanted & name.contains(part)
    for part in exclude:
        wanted = wanted & ~name.contains(part)
    return wanted


def select_files(
    source: SparkSession | DataFrame,
    path: str | None = None,
    identifiers: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Files whose names contain all ``identifiers`` and none of ``exclude``: ``(path, name)``.

    ``source`` is a session, to list the folder ``path`` with all its subfolders, or a table with
    a column ``path``. Listing reads no file contents.
    """
    if isinstance(source, SparkSession):
        scan = source.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        listed = scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    else:
        listed = source.select("path", file_name(F.col("path")).alias("name"))
    return listed.where(_selected(F.col("name"), identifiers, exclude))


def _substrings(name: Column, shortest: int, longest: int) -> Column:
    """Every part of a name of the given lengths; a file name has at most 255 characters."""
    every = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.transform(
            F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.substring(name, i, n)
        ),
    )
    return F.array_distinct(F.flatten(every))


def matching_files(ids: DataFrame, files: DataFrame, match: str = "exact", prefix: str = DOCUMENT_PREFIX) -> DataFrame:
    """All pairs of an id and a file of it: ``(doc_id, path, name)``.

    ``exact`` takes the id out of ``<prefix><id>.json``. ``substring`` takes any file whose name holds
    the prefix without its underscore and the id anywhere, so ``123`` also finds ``1234``.
    """
    if match not in ("exact", "substring"):
        raise ValueError(f"match must be 'exact' or 'substring': {match!r}")
    wanted = ids.select("doc_id").distinct()
    if match == "exact":
        named = files.where(F.col("name").startswith(prefix) & F.col("name").endswith(".json"))
        own = F.substr(F.col("name"), F.lit(len(prefix) + 1), F.length("name") - len(prefix) - len(".json"))
        return named.withColumn("doc_id", own).join(wanted, "doc_id").select("doc_id", "path", "name")
    length = wanted.agg(F.min(F.length("doc_id")).alias("shortest"), F.max(F.length("doc_id")).alias("longest"))
    bounds = length.first()
    parts = files.where(F.col("name").contains(prefix.rstrip("_"))).withColumn(
        "doc_id", F.explode(_substrings(F.col("name"), bounds["shortest"] or 1, bounds["longest"] or 1))
    )
    return parts.join(wanted, "doc_id").select("doc_id", "path", "name")


def resolve_files(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """One file per id, the smallest name of several, with the number found: ``(pos, doc_id, path, n_files)``."""
    best = matches.groupBy("doc_id").agg(
        F.min(F.struct("name", "path")).alias("best"), F.count("*").alias("n_files")
    )
    return ids.join(best.select("doc_id", "best.path", "n_files"), "doc_id").select("pos", "doc_id", "path", "n_files")


def missing_files(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """Ids without any file."""
    return ids.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
