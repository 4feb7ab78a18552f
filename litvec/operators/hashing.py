"""Approximate search by random projections: several hash tables, several probes, exact scores.

A vector's code in a table says on which side of a few hyperplanes it lies. Near vectors, by the angle
between them, share codes in some table. Questions also probe codes that differ where they lie closest to a plane.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions.nearest import finite, matrix_of, unit
from litvec.operators.blocks import BLOCK_BYTES, block_join, dimension
from litvec.operators.search import DEMO_K, _check, _rank, with_entity
from litvec.runtime import small_side, stage

TABLES, BITS, PROBES = 12, 6, 4


def planes(dim: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """Normals of the hyperplanes, (tables, bits, dim): digits of the md5 of their numbers, so that any engine can make them."""

    def component(t: int, b: int, d: int) -> int:
        return int(hashlib.md5(f"{t}-{b}-{d}".encode()).hexdigest()[:4], 16) - 32768

    return np.array([[[component(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)], dtype=np.float64)


def _sides(vectors: pa.Array, normals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are numbers, and their signed distances to all planes."""
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    matrix = matrix_of(vectors.take(pa.array(at)))
    if not len(at):
        return at, np.zeros((0, *normals.shape[:2]))
    good = finite(matrix)
    return at[good], np.einsum("nd,tbd->ntb", unit(matrix[good]), normals)


def codes(vector: Column | str, dim: int, tables: int = TABLES, bits: int = BITS, probes: int = 0) -> Column:
    """Array of codes, first those of all tables, then as many rounds of ``probes``; null for a vector that is no number.

    The first probe of a table turns the bit whose plane is nearest, the second the next one, and so on. Code
    ``c`` of table ``t`` is the number ``t * 2**bits + c``, so one number names a bucket.
    """
    if not 0 <= probes <= bits:
        raise ValueError(f"probes must be from 0 to {bits}: {probes}")
    normals = planes(dim, tables, bits)

    @F.arrow_udf("array<int>")
    def coded(vectors: pa.Array) -> pa.Array:
        at, sides = _sides(vectors, normals)
        own = ((sides >= 0) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
        turned = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probes]
        probed = own[:, :, None] ^ (1 << turned)
        every = np.concatenate([own[:, :, None], probed], axis=2).transpose(0, 2, 1).reshape(len(at), -1)
        out: list = [None] * len(vectors)
        for place, row in zip(at, every):
            out[place] = row
        return pa.array(out, pa.list_(pa.int32()))

    return coded(vector)


def knn_hashed(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEMO_K,
    where: Column | str | None = None,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The best ``k`` by cosine among the rows that share a probed bucket with the question; scores are exact.

    Only rows of probed buckets are moved, once per such bucket. Buckets are joined in blocks of bounded
    size, so one that holds a third of all rows is the work of many tasks. Fewer than ``k`` hits come where the buckets
    hold fewer. Vectors that are null or hold a null, a NaN or an infinity take no part.
    """
    _check("COSINE", k)
    asked = stage(queries.select("query_id", "vector"), "hash-questions")
    dim = dimension(asked)
    probed = asked.select("query_id", "vector", F.explode(codes("vector", dim, tables, bits, probes)).alias("bucket"))
    probed = stage(probed, "hash-probes")
    wanted = small_side(probed.select("bucket").distinct(), "hash-buckets")
    searched = corpus if where is None else corpus.where(where)
    rows = searched.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    coded = rows.select("id", "vector", F.explode(codes("vector", dim, tables, bits)).alias("bucket"))
    met = stage(coded.join(wanted, "bucket", "left_semi"), "hash-rows")
    hits = block_join(met, probed, ("bucket",), k, "COSINE", dim, block_bytes).dropDuplicates(["query_id", "id"])
    ranked = _rank(hits, k, "COSINE")
    return with_entity(ranked, corpus, fields, id_col) if fields else ranked
