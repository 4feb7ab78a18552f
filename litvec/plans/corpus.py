"""Documents to an embedded, numbered chunk table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.operators import chunking, embedding, ids
from litvec.operators.passages import DEFAULT_SECTIONS
from litvec.runtime import stage
from litvec.sources import collections
from litvec.sources import documents as docs
from litvec.sources import files

Embedder = Callable[[DataFrame], DataFrame]


def hashing(dim: int = embedding.DEMO_DIM) -> Embedder:
    """The built-in embedder; give the same one to corpus and questions."""
    return lambda df: embedding.hash_embed(df, dim)


def documents_from_files(
    spark: SparkSession, id_list: str, folder: str, match: str = "exact"
) -> tuple[DataFrame, DataFrame]:
    """Documents of the listed ids, and the ids without a file.

    A repeated id keeps its first position.
    """
    listed = files.read_id_list(spark, id_list).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    found = files.matching_files(listed, files.select_files(spark, folder), match)
    documents = docs.documents_of(docs.read_documents(spark, folder), files.resolve_files(listed, found))
    return documents, files.missing_files(listed, found)


def build_corpus(
    documents: DataFrame,
    embedder: Embedder,
    mode: str = "section",
    max_tokens: int = chunking.DEMO_MAX_TOKENS,
    sections: Sequence[str] = DEFAULT_SECTIONS,
    position: str | None = "pos",
    keep: bool = False,
) -> DataFrame:
    """Chunks with dense ids and vectors.

    Ids follow document position, section and chunk. The chunks are staged before they are sorted,
    because a range sort reads its input twice and packing is the costly part. With ``position=None``
    chunks are numbered as the documents lie, and the whole build needs no shuffle.

    Ids come before vectors: the sort moves texts only, and a reader that asks for no vectors
    does not compute them. ``keep`` stages the result, so that several readers embed once.
    """
    chunks = chunking.to_chunks(documents, mode, max_tokens, sections)
    if position is None:
        built = embedder(ids.dense_ids(chunks))
    else:
        order = (position, "section", "chunk_no") if mode == "section" else (position, "chunk_no")
        built = embedder(ids.dense_ids(stage(chunks, "chunks"), *order))
    return stage(built, "corpus") if keep else built


def store_corpus(
    documents: DataFrame,
    embedder: Embedder,
    namespace: str,
    name: str,
    dim: int,
    metric: str = "COSINE",
    mode: str = "section",
    max_tokens: int = chunking.DEMO_MAX_TOKENS,
    sections: Sequence[str] = DEFAULT_SECTIONS,
) -> int:
    """Build a corpus and write it as a collection with its metadata; returns the number of chunks."""
    built = build_corpus(documents, embedder, mode, max_tokens, sections)
    return collections.write_collection(built, namespace, name, dim, metric)
