"""Nearest rows inside one task: numpy and Arrow only, so that workers load little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Scores that agree in this many decimals of a cosine, or digits of another score, are equal: the order
# of summation decides no rank, whatever the length of the vectors. The smaller id is then the nearer one.
COSINE_DECIMALS, DIGITS = 9, 12
# Fixed value: smallest divisor used when normalising.
MIN_NORM = 1e-12
# A task compares this many corpus rows with this many queries at a time: the scores stay in the cache.
_ROWS, _QUERIES = 1024, 256
# Candidates kept before they are reduced to the best k, beside twice the result, and those scored exactly at a time.
_BUFFERED, _SCORED = 1 << 18, 1 << 14


def matrix_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors, none of them null, as a matrix of doubles; all must have the same length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths.tolist()))}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def with_vector(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Leave out rows without a vector. A filter before the scan would compute a lazy vector twice."""
    return batch.filter(batch["vector"].is_valid()) if batch["vector"].null_count else batch


def finite(m: np.ndarray) -> np.ndarray:
    """Which rows hold numbers only: no NaN, no infinity, no null element (read as NaN)."""
    return np.isfinite(m).all(axis=1)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), MIN_NORM)


def _exact(corpus: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Score row by row, higher is nearer; equal rows give equal scores wherever they stand."""
    if metric == "L2":
        gap = corpus - queries
        score = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
    else:
        score = np.einsum("ij,ij->i", corpus, queries)
    return np.round(score, COSINE_DECIMALS) if metric == "COSINE" else _significant(score)


def paired_scores(corpus: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """The scores that ``Best`` gives, of row ``i`` with query ``i``; a distance for L2."""
    if not len(corpus):
        return np.zeros(0)
    if metric == "COSINE":
        corpus, queries = unit(corpus), unit(queries)
    score = _exact(corpus, queries, metric)
    return -score if metric == "L2" else score


def _significant(score: np.ndarray) -> np.ndarray:
    """Rounded to DIGITS significant digits; what is too small or too large for that stays as it is."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        factor = 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.abs(score))))
        rounded = np.round(score * factor) / factor
    return np.where(np.isfinite(rounded), rounded, score)


class Best:
    """The best ``k`` hits per query seen so far by one task.

    A quick single-precision product of tiles finds the candidates: all rows that come within its
    error of the k-th best. Only they are scored exactly.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.metric, self.k = metric, k
        self.queries = unit(queries) if metric == "COSINE" else queries
        self.quick = self.queries.astype(np.float32)
        self.squares = (self.queries * self.queries).sum(1)
        self.floor = np.full(len(queries), -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.buffer: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.buffered = 0

    def add(self, ids: np.ndarray, corpus: np.ndarray, which: np.ndarray | None = None) -> None:
        """Take in corpus rows; ``which`` names the queries they are compared with. Rows that are not finite have no score."""
        which = np.arange(len(self.queries)) if which is None else which
        good = finite(corpus)
        if not good.all():
            ids, corpus = ids[good], corpus[good]
        if not len(which) or not len(ids):
            return
        rows = max(_ROWS, _ROWS * _QUERIES // min(len(which), _QUERIES))
        for r in range(0, len(ids), rows):
            part = corpus[r : r + rows]
            part = unit(part) if self.metric == "COSINE" else part
            quick, squares = part.astype(np.float32), (part * part).sum(1)
            for q in range(0, len(which), _QUERIES):
                tile = which[q : q + _QUERIES]
                self._compare(ids[r : r + rows], part, quick @ self.quick[tile].T, squares, tile)
                if self.buffered > _BUFFERED + 2 * self.k * len(self.queries):
                    self._reduce()
            # The first rows give all queries a floor, so that few of the next are candidates.
            if self.buffered >= self.k * np.count_nonzero(np.isinf(self.floor[which])) > 0:
                self._reduce()

    def _compare(self, ids, corpus, scores, squares, tile) -> None:
        longest = np.sqrt(squares.max()) + np.sqrt(self.squares[tile].max())
        error = (corpus.shape[1] + 8) * np.finfo(np.float32).eps * longest**2
        if self.metric == "L2":  # minus the squared distance
            scores *= 2
            scores -= squares.astype(np.float32)[:, None]
            scores -= self.squares[tile].astype(np.float32)
        floor = self.floor[tile]
        if len(ids) >= self.k and not np.isfinite(floor).all():
            kth = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            floor = np.maximum(floor, kth - error)
        lowest = np.nextafter((floor - error).astype(np.float32), np.float32(-np.inf))
        row, q = np.divmod(np.flatnonzero(scores >= lowest), len(tile))
        for a in range(0, len(row), _SCORED):
            some, whose = row[a : a + _SCORED], tile[q[a : a + _SCORED]]
            self.buffer.append((whose, ids[some], _exact(corpus[some], self.queries[whose], self.metric)))
        self.buffered += len(row)

    def _reduce(self) -> None:
        q, ids, score = (np.concatenate(c) for c in zip(self.kept, *self.buffer))
        self.buffer, self.buffered = [], 0
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.kept = (q[keep], ids[keep], score[keep])
        last = rank == self.k - 1
        # Equal after rounding means equal: the floor lies a rounding step below the k-th score.
        step = 10.0**-COSINE_DECIMALS if self.metric == "COSINE" else np.abs(score[last]) * 10.0 ** (1 - DIGITS)
        lowest = score[last] - 2 * step
        self.floor[q[last]] = -(lowest**2) if self.metric == "L2" else lowest

    def hits(self, query_ids: pa.Array) -> pa.RecordBatch:
        self._reduce()
        q, ids, score = self.kept
        score = -score if self.metric == "L2" else score
        columns = [query_ids.take(pa.array(q)), pa.array(ids), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])
