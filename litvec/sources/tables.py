"""Passage, section, chunk and embedding tables, as Parquet or as tab separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.functions.vector import parse_vector

# Quoting as in the CSV dialect of common table libraries: quotes are doubled, cells may span lines.
_TSV = {
    "sep": "\t",
    "header": True,
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


# Line ends inside cells as percent codes, the percent sign too: every row is one line and files can be split.
_CODES = (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"))


def _coded(df: DataFrame, decode: bool) -> DataFrame:
    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        for plain, code in reversed(_CODES) if decode else _CODES:
            value = F.replace(value, F.lit(code if decode else plain), F.lit(plain if decode else code))
        return value.alias(name)

    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[cell(c) if c in text else F.col(f"`{c}`") for c in df.columns])


def write_table(
    df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), one_line: bool = False
) -> None:
    """Write a table; in the ``tsv`` form arrays become JSON text.

    ``one_line`` codes line ends inside cells, so that large files are read by many tasks.
    """
    if format == "tsv":
        df = df.select(
            [
                F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
                for f in df.schema.fields
            ]
        )
        df = _coded(df, decode=False) if one_line else df
        df.write.mode("overwrite").options(**_TSV).option("emptyValue", "").csv(path)
    elif format == "parquet":
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        raise ValueError(f"format must be 'parquet' or 'tsv': {format!r}")


def read_tsv(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Table written as text; every column is text, and empty cells are null.

    Cells may span lines, so a file is one task, unless it was written with ``one_line``.
    """
    if one_line:
        return _coded(spark.read.options(**_TSV | {"multiLine": False}).csv(path), decode=True)
    return spark.read.options(**_TSV).csv(path)


def with_bucket(df: DataFrame, key: str, buckets: int, name: str = "doc_bucket") -> DataFrame:
    """Add a folder number of the key, for tables of many documents in few folders."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_embeddings_tsv(
    df: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector", one_line: bool = False
) -> None:
    """Embedding table as text: the row id first, the vector as ``embedding``; ``one_line`` is that of ``write_table``."""
    rest = [c for c in df.columns if c not in (id_col, vector_col)]
    write_table(df.select(id_col, *rest, F.col(vector_col).alias("embedding")), path, "tsv", one_line=one_line)


def read_embeddings_tsv(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Embedding table from text: the first column, named or not, is ``id`` and ``embedding`` is ``vector``.

    All other columns stay text, so ids keep their leading zeros. A file is one task unless it was written
    with ``one_line``.
    """
    read = read_tsv(spark, path, one_line)
    first = read.columns[0]
    rest = [c for c in read.columns[1:] if c != "embedding"]
    return read.select(
        F.col(f"`{first}`").cast("long").alias("id"),
        *rest,
        parse_vector("embedding").cast("array<float>").alias("vector"),
    )
