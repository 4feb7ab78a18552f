"""Nearest neighbours with both sides distributed: corpus and questions meet in blocks, no loop on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.functions.nearest import Best, finite, matrix_of, with_vector
from litvec.operators.search import DEMO_K, _check, _rank, with_entity
from litvec.runtime import small_side, stage

# Vectors of one side that meet in a task, in bytes as doubles; a question is held in two precisions, with its hits.
BLOCK_BYTES = 32 << 20
_HIT_BYTES = 64
# Every row goes to all blocks of the other side: from this many blocks of a side on, smaller ones grow up to BLOCK_BYTES.
SIDE_BLOCKS = 16
# Rows of a block that are doubles at a time.
_DOUBLES = 8192


def _hit_type(queries: DataFrame) -> T.StructType:
    fields = [("query_id", queries.schema["query_id"].dataType), ("id", T.LongType()), ("score", T.DoubleType())]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def block_join(
    rows: DataFrame, asked: DataFrame, buckets: Sequence[str], k: int, metric: str, dim: int, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Best ``k`` rows ``(id, vector)`` of every question ``(query_id, vector)`` in the same bucket, block by block.

    A bucket of many rows or questions is a grid of blocks of bounded size, so no bucket is too hot:
    a row goes to every block of its bucket's questions, a question to every block of its rows. Blocks are cut by a hash
    of the id. Each block passes on its ``k`` best per question. Both sides are read twice, so stage them. Blocks of less
    than ``BLOCK_BYTES`` grow up to that size where a bucket would have more than ``SIDE_BLOCKS`` of them on a side.
    """

    def parts(side: DataFrame, each_bytes: int, name: str) -> DataFrame:
        least, most = (max(1, size // each_bytes) for size in (block_bytes, max(block_bytes, BLOCK_BYTES)))
        size = F.greatest(F.lit(least), F.least(F.ceil(F.col("n") / SIDE_BLOCKS), F.lit(most)))
        counted = side.groupBy(*buckets).agg(F.count("*").alias("n"))
        return counted.select(*buckets, F.ceil(F.col("n") / size).cast("int").alias(name))

    of_rows, of_asked = parts(rows, 8 * dim, "row_blocks"), parts(asked, 2 * (8 * dim + _HIT_BYTES * k), "asked_blocks")
    if buckets:
        grid = small_side(of_rows.join(of_asked, [*buckets]), "block-grid")
    else:
        whole = {**of_rows.first().asDict(), **of_asked.first().asDict()}

    def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        if buckets:
            met = side.join(grid, [*buckets])
        else:
            met = side.withColumns({name: F.lit(max(1, n)) for name, n in whole.items()})
        block = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return met.select(*buckets, key, "vector", block, each)

    def best(found: pa.Table, questions: pa.Table) -> pa.Table:
        questions = questions.filter(pc.is_valid(questions["vector"]))
        ids, matrix = questions["query_id"].combine_chunks(), matrix_of(questions["vector"])
        good = finite(matrix)
        if not good.all():
            ids, matrix = ids.filter(pa.array(good, pa.bool_())), matrix[good]
        top = Best(matrix, k, metric)
        for batch in found.to_batches(_DOUBLES):
            batch = with_vector(batch)
            top.add(batch["id"].to_numpy(zero_copy_only=False), matrix_of(batch["vector"]))
        return pa.Table.from_batches([top.hits(ids)])

    key = [*buckets, "row_block", "asked_block"]
    left, right = dealt(rows, "id", "row", "asked"), dealt(asked, "query_id", "asked", "row")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, _hit_type(asked))


def dimension(vectors: DataFrame) -> int:
    """The largest length of a staged table's vectors, 1 for none."""
    return max(1, vectors.agg(F.max(F.size("vector"))).first()[0] or 1)


def knn_joined(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows that ``search.knn`` gives, for any number of questions in one plan.

    The corpus is scanned once and its vectors staged, whatever the number of questions; nothing but block counts comes to the
    driver. Vectors that are null or hold a null, a NaN or an infinity have no neighbours. Ids of the
    corpus should be unique, as blocks are cut by them.
    """
    metric = _check(metric, k)
    searched = corpus if where is None else corpus.where(where)
    rows = stage(searched.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")), "block-rows")
    asked = stage(queries.select("query_id", "vector"), "block-questions")
    hits = _rank(block_join(rows, asked, (), k, metric, dimension(asked), block_bytes), k, metric)
    return with_entity(hits, corpus, fields, id_col) if fields else hits
