"""Approximate search over compressed vectors: a byte per part of a vector, exact scores for the best.

A vector is cut into parts; each part becomes the number of the nearest of up to 256 code vectors. A question
has a table of its score with every code vector, so a compressed row is scored by as many look-ups as it has parts.
The best rows are scored again from the full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.functions.nearest import Best, finite, matrix_of, paired_scores, unit, with_vector
from litvec.operators.search import DEMO_K, _check, _rank, _search, with_entity
from litvec.runtime import small_side, stage

PARTS, CODES = 8, 256
# Code vectors are fitted on a sample of at most this many vectors, by this many passes over it.
FIT_ROWS, FIT_PASSES = 20_000, 12
# Rows that are scored exactly, for each hit that is asked for.
RERANK = 20
_ROWS = 4096


def _cut(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(matrix, parts, axis=1)


def _nearest_code(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)


def fit_codebooks(
    corpus: DataFrame,
    parts: int = PARTS,
    codes: int = CODES,
    metric: str = "COSINE",
    id_col: str = "id",
    vector_col: str = "vector",
    sample: int = FIT_ROWS,
) -> list[np.ndarray]:
    """Code vectors of every part, fitted on the ``sample`` vectors with the smallest hashes of their ids.

    The sample does not grow with the corpus, so it is fitted on the driver. Fewer vectors than ``codes`` give
    fewer code vectors, none give a single zero.
    """
    cosine = _check(metric, 1) == "COSINE"
    if not 1 <= codes <= 256:
        raise ValueError(f"codes must be from 1 to 256: {codes}")
    good = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & good).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample)
    matrix = matrix_of(rows.toArrow()["vector"])
    if not len(matrix):
        return [np.zeros((1, 1))] * parts
    books = []
    for part in _cut(unit(matrix) if cosine else matrix, parts):
        book = np.unique(part, axis=0)
        book = book[np.linspace(0, len(book) - 1, min(codes, len(book))).astype(int)]
        for _ in range(FIT_PASSES):
            own = _nearest_code(part, book)
            n = np.bincount(own, minlength=len(book))
            sums = np.stack([np.bincount(own, part[:, d], len(book)) for d in range(part.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return books


def save_codebooks(spark: SparkSession, books: list[np.ndarray], path: str) -> None:
    """Write code vectors as a table of ``part, code, vector``."""
    rows = [(p, c, [float(x) for x in v]) for p, book in enumerate(books) for c, v in enumerate(book)]
    spark.createDataFrame(rows, "part int, code int, vector array<double>").coalesce(1).write.parquet(path)


def load_codebooks(spark: SparkSession, path: str) -> list[np.ndarray]:
    rows = spark.read.parquet(path).orderBy("part", "code").collect()  # at most 256 per part
    return [np.array([r["vector"] for r in rows if r["part"] == p]) for p in sorted({r["part"] for r in rows})]


def compress(
    corpus: DataFrame, books: list[np.ndarray], metric: str = "COSINE", id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """``id, code``: a byte per part. Rows without a vector of numbers are left out. Write it beside the corpus."""
    cosine = _check(metric, 1) == "COSINE"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = with_vector(batch)
            matrix = matrix_of(batch["vector"])
            if not len(matrix):
                continue
            good = finite(matrix)
            matrix = unit(matrix[good]) if cosine else matrix[good]
            codes = np.stack([_nearest_code(p, b) for p, b in zip(_cut(matrix, len(books)), books)], axis=1).astype("u1")
            ids = batch["id"].filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(coded, "id long, code binary")


def _tables(queries: np.ndarray, books: list[np.ndarray], metric: str) -> list[np.ndarray]:
    """Per part the score of every question with every code vector, higher is nearer; for L2 minus the squared distance."""
    parts = _cut(unit(queries) if metric == "COSINE" else queries, len(books))
    if metric == "L2":
        return [2 * q @ b.T - (b * b).sum(1) - (q * q).sum(1)[:, None] for q, b in zip(parts, books)]
    return [q @ b.T for q, b in zip(parts, books)]


def knn_quantized(
    corpus: DataFrame,
    compressed: DataFrame,
    queries: DataFrame,
    books: list[np.ndarray],
    k: int = DEMO_K,
    metric: str = "COSINE",
    rerank: int = RERANK,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    where: Column | str | None = None,
) -> DataFrame:
    """Hits of every question: the best ``rerank * k`` rows by their codes, ranked by exact scores.

    All rows of ``compressed`` are read, a byte per part; of the corpus only the vectors of the chosen rows are
    scored. ``where`` is a filter on columns of ``compressed``, which may carry more than id and code. With ``rerank * k``
    rows or fewer in the corpus the result is exact.
    """
    metric = _check(metric, k)
    kept = compressed if where is None else compressed.where(where)
    rows = kept.select(F.col("id").cast("long").alias("id"), "code")
    wide = rerank * k
    asked = stage(queries.select("query_id", "vector"), "questions")

    def scan(matrix):
        tables = _tables(matrix, books, metric)

        def compare(batch: pa.RecordBatch, best: Best) -> None:
            if not batch.num_rows:
                return
            ids = batch["id"].to_numpy(zero_copy_only=False)
            codes = np.array([np.frombuffer(c, "u1") for c in batch["code"].to_pylist()])
            for a in range(0, len(ids), _ROWS):
                part = codes[a : a + _ROWS]
                scores = sum(t[:, part[:, p]] for p, t in enumerate(tables))
                top = min(wide, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
                q, at = np.nonzero(scores >= least[:, None])  # rows of equal codes tie, and the smaller ids stay
                best.buffer.append((q, ids[a : a + _ROWS][at], scores[q, at]))
                best.buffered += len(q)
            if best.buffered > (1 << 18) + 2 * wide * len(matrix):
                best._reduce()

        return rows, compare

    near = _search(asked, wide, "IP", scan)  # higher is nearer in all tables
    chosen = small_side(near.select("query_id", "id"), "chosen")
    vectors = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    pairs = vectors.join(chosen, "id").join(small_side(asked.select("query_id", F.col("vector").alias("asked")), "asked"), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = paired_scores(matrix_of(batch["vector"]), matrix_of(batch["asked"]), metric)
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["id"], pa.array(score)], ["query_id", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    scored = pairs.select("query_id", "id", "vector", "asked").mapInArrow(exact, f"query_id {kinds['query_id']}, id long, score double")
    hits = _rank(scored, k, metric)
    return with_entity(hits, corpus, fields, id_col) if fields else hits
