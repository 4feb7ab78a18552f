"""Annotated JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.runtime import BROADCAST_ROWS, small_side

# Field names of a document and of the response that wraps it.
DOCUMENT = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("pmcid", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("journal", T.StringType()),
        T.StructField(
            "passages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("infons", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
ENVELOPE = "PubTator3"
_CORRUPT = "_corrupt_record"


def _read(spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool) -> DataFrame:
    """JSON objects with the path of their file; the text of a broken one is kept for the quarantine."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("multiLine", one_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def _is_whole(length_of_field: Column) -> Column:
    """True for a valid object. A field is looked at beside the corrupt column, which Spark does not scan alone."""
    return F.col(_CORRUPT).isNull() & (F.coalesce(length_of_field, F.lit(-1)) >= -1)


def read_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Documents of a folder with the path of their file; broken ones are left out.

    ``one_per_file`` expects one object per file, as downloads land; otherwise one per line, the
    form to keep large collections in.
    """
    read = _read(spark, path, DOCUMENT, one_per_file)
    return read.where(_is_whole(F.length("pmid"))).drop(_CORRUPT)


def read_responses(
    spark: SparkSession, path: str, one_per_file: bool = True, envelope: str = ENVELOPE
) -> DataFrame:
    """First document of every landed response; responses without one give no row."""
    wrapped = T.StructType([T.StructField(envelope, T.ArrayType(DOCUMENT))])
    read = _read(spark, path, wrapped, one_per_file)
    first = read.where(_is_whole(F.size(envelope))).select(F.get(F.col(envelope), F.lit(0)).alias("d"), "path")
    return first.where(F.col("d").isNotNull()).select("d.*", "path")


def broken_files(
    spark: SparkSession, path: str, one_per_file: bool = True, envelope: str | None = None
) -> DataFrame:
    """Path and text of whatever is no valid JSON object."""
    schema = T.StructType([T.StructField(envelope, T.ArrayType(DOCUMENT))]) if envelope else DOCUMENT
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=one_per_file)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = F.from_json("value", with_corrupt, {"columnNameOfCorruptRecord": _CORRUPT})
    return texts.where(parsed[_CORRUPT].isNotNull()).withColumnRenamed("value", _CORRUPT)


def documents_of(documents: DataFrame, resolved: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """The documents whose files ``resolve_files`` chose, with their ``doc_id`` and position.

    A short list of files goes to the document scan; a longer one is joined by shuffle.
    """
    chosen = small_side(resolved.select("pos", "doc_id", "path"), "resolved", max_broadcast)
    return documents.join(chosen, "path").drop("path")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines."""
    documents.select([f.name for f in DOCUMENT.fields]).write.mode("overwrite").json(path)
