"""Search in cells that knows what it leaves out: exact with bounds, filtered without missing hits.

Cells are those of ``search.assign_cells``, which gives none to a vector that is no number, so a cell's
rows can be counted without reading vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions.nearest import Best, finite, matrix_of, unit, with_vector
from litvec.operators.search import DEMO_K, _check, _near, _rank, _search, cell_scan, with_entity

# Slack for sums of rounded products: relative to the lengths that enter a bound.
_SLACK = 1e-7


def cell_bounds(
    celled: DataFrame, centroids: np.ndarray, metric: str = "COSINE", vector_col: str = "vector", cell: str = "cell"
) -> DataFrame:
    """``cell, n, radius``: rows of every cell and the largest distance of one to its centroid.

    One pass over the vectors, of which a row per task and cell is shuffled; keep it with the centroids. Distances
    are between unit vectors for ``COSINE``.
    """
    cosine = _check(metric, 1) == "COSINE"

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for batch in batches:
            batch = with_vector(batch)
            matrix = matrix_of(batch["vector"])
            if not len(matrix):
                continue
            good = finite(matrix)
            cells = batch["cell"].to_numpy(zero_copy_only=False)[good].astype(np.int64)
            rows = unit(matrix[good]) if cosine else matrix[good]
            n += np.bincount(cells, minlength=len(centroids))
            np.maximum.at(radius, cells, np.linalg.norm(rows - centroids[cells], axis=1))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(radius[at])], ["cell", "n", "radius"])

    vectors = celled.select(F.col(vector_col).alias("vector"), F.col(cell).cast("int").alias("cell")).where("cell is not null")
    parts = vectors.mapInArrow(farthest, "cell int, n long, radius double")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))


def _of_cells(table: DataFrame, name: str, cells: int) -> np.ndarray:
    out = np.zeros(cells)
    for r in table.select("cell", name).collect():  # one row per cell
        out[r["cell"]] = r[name]
    return out


def _first_cells(near: np.ndarray, counts: np.ndarray, k: int, probes: int) -> np.ndarray:
    """Which cells each question reads to meet ``k`` rows for certain: the nearest that have any, ``probes`` at least."""
    order = np.argsort(-near, axis=1, kind="stable")
    filled = counts[order]
    before = np.cumsum(filled, axis=1) - filled
    seen = np.cumsum(filled > 0, axis=1) - (filled > 0)
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, order, (filled > 0) & ((before < k) | (seen < probes)), axis=1)
    return out


def _upper(matrix: np.ndarray, centroids: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """What no row of a cell can exceed: a score for COSINE and IP, minus a distance for L2."""
    if metric == "IP":
        lengths = np.linalg.norm(matrix, axis=1)[:, None]
        top = matrix @ centroids.T + lengths * radius
        return top + _SLACK * lengths * (np.linalg.norm(centroids, axis=1) + radius)
    asked = unit(matrix) if metric == "COSINE" else matrix
    gap = np.empty((len(asked), len(centroids)))
    for c, centroid in enumerate(centroids):
        gap[:, c] = np.linalg.norm(asked - centroid, axis=1)
    size = np.linalg.norm(asked, axis=1)[:, None] + np.linalg.norm(centroids, axis=1) + radius
    least = np.maximum(gap - radius - _SLACK * size, 0)
    return 1 - least * least / 2 + _SLACK if metric == "COSINE" else -least


def _corpus(celled: DataFrame, where: Column | str | None, id_col: str, vector_col: str, cell: str) -> DataFrame:
    searched = celled if where is None else celled.where(where)
    return searched.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(cell).cast("int").alias("cell")
    )


def _counts(celled: DataFrame, where: Column | str | None, cell: str, cells: int) -> np.ndarray:
    kept = celled if where is None else celled.where(where)
    return _of_cells(kept.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n")), "n", cells)


def knn_filtered_cells(
    celled: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    probes: int,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    cell: str = "cell",
) -> DataFrame:
    """Approximate search under a filter that never returns fewer hits than there are.

    The filtered rows of every cell are counted first. A question reads its nearest cells that hold any, ``probes``
    of them at least, and goes on until they hold ``k`` rows, however rare the filter's rows are. Scores are exact.
    """
    metric = _check(metric, k)
    vectors, counts = _corpus(celled, where, id_col, vector_col, cell), _counts(celled, where, cell, len(centroids))

    def scan(matrix):
        return cell_scan(vectors, _first_cells(_near(matrix, centroids, metric, probing=True), counts, k, probes))

    hits = _search(queries.select("query_id", "vector"), k, metric, scan)
    return with_entity(hits, celled, fields, id_col) if fields else hits


def knn_pruned(
    celled: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    bounds: DataFrame,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    cell: str = "cell",
    report: list[dict] | None = None,
) -> DataFrame:
    """The exact hits of ``search.knn``, from the cells that can hold one.

    A first scan reads the nearest cells until they hold ``k`` rows; its k-th score is a floor. By
    the triangle inequality a cell whose centroid is too far for its radius cannot reach the floor, and a second scan reads
    the others only. ``bounds`` comes from ``cell_bounds`` of the same cells. ``report`` receives, for every block of
    questions, the mean numbers of cells and rows that a question read in both scans, and of those there are.
    """
    metric = _check(metric, k)
    radius = _of_cells(bounds, "radius", len(centroids))
    vectors, counts = _corpus(celled, where, id_col, vector_col, cell), _counts(celled, where, cell, len(centroids))

    def floor_of(matrix: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The k-th score of every question in its first cells, higher is nearer; none with fewer rows."""
        rows, compare = cell_scan(vectors, first)

        def local_top(batches):
            best = Best(matrix, k, metric)
            for batch in batches:
                compare(batch, best)
            yield best.hits(pa.array(np.arange(len(matrix))))

        ranked = _rank(rows.mapInArrow(local_top, "query_id long, id long, score double"), k, metric)
        out = np.full(len(matrix), -np.inf)
        for r in ranked.where(F.col("rank") == k).select("query_id", "score").collect():  # one row per question of the block
            out[r["query_id"]] = -r["score"] if metric == "L2" else r["score"]
        return out

    def scan(matrix):
        first = _first_cells(_near(matrix, centroids, metric, probing=True), counts, k, 1)
        floor = floor_of(matrix, first)[:, None]
        slack = _SLACK * np.maximum(1.0, np.abs(np.where(np.isfinite(floor), floor, 0)))
        needed = (_upper(matrix, centroids, radius, metric) >= floor - slack) & (counts > 0)
        if report is not None:
            read = first.sum(1) + needed.sum(1)
            rows = first @ counts + needed @ counts
            report.append(
                {"questions": len(matrix), "cells": float(read.mean()), "rows": float(rows.mean()),
                 "of_cells": int((counts > 0).sum()), "of_rows": int(counts.sum())}
            )
        return cell_scan(vectors, needed)

    hits = _search(queries.select("query_id", "vector"), k, metric, scan)
    return with_entity(hits, celled, fields, id_col) if fields else hits
