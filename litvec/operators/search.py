"""Nearest neighbours: exact block search, search in cells, recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.functions.nearest import Best, finite, matrix_of, unit, with_vector
from litvec.functions.vector import l2_normalize
from litvec.runtime import BROADCAST_ROWS, small_side, stage

METRICS = ("COSINE", "IP", "L2")
# Fixed value: hits per query of the demo configuration.
DEMO_K = 10

# Queries travel to every task in blocks: this many at least, and more while they stay below the bytes.
QUERY_BLOCK = 2048
QUERY_BLOCK_BYTES = 64 << 20
# On a cluster with this many task slots the hits of a query are merged in two steps.
_MANY_SLOTS = 512
_SALTS = 64
# Every task passes on k hits per query. From this many hits on, fewer and longer tasks read the corpus.
_MANY_HITS = 100_000
_TASKS_PER_SLOT = 4
# Rows that centroids are fitted on, for each cell.
FIT_PER_CELL = 1000


def _rank(hits: DataFrame, k: int, metric: str) -> DataFrame:
    """Global top ``k`` per query from the hits of the tasks, ties to the smaller id."""
    order = [F.asc("score") if metric == "L2" else F.desc("score"), F.asc("id")]
    if hits.sparkSession.sparkContext.defaultParallelism > _MANY_SLOTS:
        salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
        some = Window.partitionBy("query_id", salt).orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    each = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)


Block = Callable[[], pa.Table]


def _blocks(queries: DataFrame, least: int, most_bytes: int) -> tuple[list[Block], DataFrame]:
    """The queries as tables of bounded size, each fetched when it is called for, and a table to read them from.

    One small job when they fit into the least block; more queries are staged.
    """
    head = queries.limit(least + 1).toArrow()
    if head.num_rows <= least:
        return [lambda: head], queries
    dim = max((len(v) for v in head["vector"].to_pylist() if v is not None), default=1)
    block = max(least, most_bytes // (8 * max(1, dim)))
    # The hash spreads unevenly: aim at blocks that are three quarters full.
    staged = stage(queries, "queries")
    n = -(-4 * staged.count() // (3 * block))
    return [lambda i=i: staged.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow() for i in range(n)], staged


def _check(metric: str, k: int) -> str:
    if metric.upper() not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}: {metric!r}")
    if k < 1:
        raise ValueError(f"k must be positive: {k}")
    return metric.upper()


def _search(
    queries: DataFrame,
    k: int,
    metric: str,
    scan: Callable[[np.ndarray], tuple[DataFrame, Callable[[pa.RecordBatch, Best], None]]],
    block_bytes: int = QUERY_BLOCK_BYTES,
    many: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``scan`` names the corpus rows to read for a block of queries and how a batch is compared.

    A batch of another vector length than the queries fails the job. Queries of several blocks are
    searched by ``many`` if it is given. Otherwise each block is searched in a job of its own whose hits
    are staged, so the driver holds one block at a time, however many queries there are.
    """
    least = min(QUERY_BLOCK, max(1, block_bytes // 8))
    hit = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    found = queries.sparkSession.createDataFrame([], hit)
    blocks, asked = _blocks(queries, least, block_bytes)
    several = len(blocks) > 1
    if several and many is not None:
        return many(asked)
    for fetch in blocks:
        block = fetch()
        block = block.filter(pc.is_valid(block["vector"]))
        query_ids, matrix = block["query_id"].combine_chunks(), matrix_of(block["vector"])
        good = finite(matrix)
        query_ids, matrix = query_ids.filter(pa.array(good, pa.bool_())), matrix[good]
        if not len(matrix):
            continue
        rows, compare = scan(matrix)

        def local_top(batches, query_ids=query_ids, matrix=matrix, compare=compare):
            best = Best(matrix, k, metric)
            for batch in batches:
                compare(batch, best)
            yield best.hits(query_ids)

        if len(matrix) * k > _MANY_HITS:
            rows = rows.coalesce(_TASKS_PER_SLOT * rows.sparkSession.sparkContext.defaultParallelism)
        hits = rows.mapInArrow(local_top, hit)
        found = found.union(stage(hits, "block-hits") if several else hits)
    return _rank(found, k, metric)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEMO_K,
    metric: str = "COSINE",
    where: Column | str | None = None,
    fields: Sequence[str] = (),
    id_col: str = "id",
    vector_col: str = "vector",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The exact ``k`` nearest corpus rows of every query ``(query_id, vector)``.

    ``COSINE`` and ``IP`` rank by descending score, ``L2`` by ascending distance. Each task
    multiplies its corpus batches with the query matrix and passes on ``k`` hits per query; pairs
    are never rows. ``where`` filters the corpus first. ``fields`` that the corpus has are returned
    as ``entity``. Vectors that are null or hold a null, a NaN or an infinity have no neighbours and
    are nobody's neighbour. Questions that do not fit one block of ``block_bytes`` are searched by
    ``blocks.knn_joined``, which reads the corpus once for all of them.
    """
    from litvec.operators.blocks import knn_joined  # it builds on this module

    metric = _check(metric, k)
    searched = corpus if where is None else corpus.where(where)
    vectors = searched.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))

    def scan(_matrix):
        def compare(batch: pa.RecordBatch, best: Best) -> None:
            batch = with_vector(batch)
            best.add(batch["id"].to_numpy(zero_copy_only=False), matrix_of(batch["vector"]))

        return vectors, compare

    def many(asked: DataFrame) -> DataFrame:
        return knn_joined(corpus, asked, k, metric, where, (), id_col, vector_col)

    hits = _search(queries.select("query_id", "vector"), k, metric, scan, block_bytes, many)
    return with_entity(hits, corpus, fields, id_col) if fields else hits


def with_entity(
    hits: DataFrame,
    corpus: DataFrame,
    fields: Sequence[str],
    id_col: str = "id",
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the named corpus columns of each hit as a struct ``entity``; unknown names are left out.

    A small set of hits goes to the corpus scan, not the corpus to it. Of many hits the distinct ids go there, and only
    the rows they name are moved; the corpus itself is shuffled by id beyond ``max_broadcast`` ids.
    """
    known = [f for f in fields if f in corpus.columns]
    source = corpus.select(F.col(id_col).cast("long").alias("id"), F.struct(*known).alias("entity"))
    met = stage(hits, "hits")
    if met.count() <= max_broadcast:
        found = source.join(small_side(met, "few-hits", max_broadcast), "id")
    else:
        ids = small_side(met.select("id").distinct(), "hit-ids", max_broadcast)
        found = met.join(source.join(ids, "id", "left_semi"), "id")
    return found.select("query_id", "rank", "id", "score", "entity")


def entities(hits: DataFrame) -> DataFrame:
    """Hits with the entity fields as columns."""
    return hits.select("query_id", "rank", "score", "entity.*")


def fit_cells(
    corpus: DataFrame,
    cells: int,
    seed: int = 42,
    vector_col: str = "vector",
    max_iter: int = 10,
    metric: str = "COSINE",
    per_cell: int = FIT_PER_CELL,
) -> np.ndarray:
    """Centroids of a k-means, one row per cell; of unit vectors for ``COSINE``.

    They are fitted on a random sample of about ``per_cell`` rows for each cell, on all rows of a smaller corpus;
    every row is put into a cell afterwards. The sample is staged once, as k-means reads it in every pass. Null vectors are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cosine = _check(metric, 1) == "COSINE"
    rows = corpus.count()
    if rows > per_cell * cells:
        corpus = corpus.where(F.rand(seed) < per_cell * cells / rows)
    vectors = stage(corpus.select(F.col(vector_col).alias("v")), "cell-vectors").where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )
    features = l2_normalize("v") if cosine else F.col("v")
    model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(vectors.select(array_to_vector(features).alias("features")))
    centroids = np.asarray(model.clusterCenters(), dtype=np.float64)
    return unit(centroids) if cosine else centroids


def _near(matrix: np.ndarray, centroids: np.ndarray, metric: str, probing: bool) -> np.ndarray:
    """How near each row is to each centroid, higher is nearer. Rows lie in cells by cosine or distance."""
    if metric == "COSINE":
        return unit(matrix) @ centroids.T
    if metric == "IP" and probing:
        return matrix @ centroids.T
    return 2 * matrix @ centroids.T - (centroids * centroids).sum(1)


def assign_cells(
    corpus: DataFrame, centroids: np.ndarray, vector_col: str = "vector", cell: str = "cell", metric: str = "COSINE"
) -> DataFrame:
    """Add the number of the cell whose centroid is nearest; null without a finite vector.

    Write the corpus partitioned by it.
    """
    metric = _check(metric, 1)

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        found = np.full(len(vectors), -1, np.int32)
        at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        matrix = matrix_of(vectors.take(pa.array(at)))
        if len(at):
            good = finite(matrix)
            found[at[good]] = np.argmax(_near(matrix[good], centroids, metric, probing=False), axis=1)
        return pa.array(found, mask=found < 0)

    return corpus.withColumn(cell, nearest(vector_col))


def save_centroids(spark: SparkSession, centroids: np.ndarray, path: str) -> None:
    """Write centroids as a table of ``cell, centroid``."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(path)


def load_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("cell").collect()
    return np.array([r.centroid for r in rows], dtype=np.float64)


def cell_scan(vectors: DataFrame, which: np.ndarray) -> tuple[DataFrame, Callable[[pa.RecordBatch, Best], None]]:
    """Rows ``(id, vector, cell)`` of the cells that any question reads, and how a batch is compared.

    ``which`` says per question and cell whether the question reads the cell.
    """
    probed = {int(c): np.flatnonzero(which[:, c]) for c in np.flatnonzero(which.any(axis=0))}

    def compare(batch: pa.RecordBatch, best: Best) -> None:
        batch = with_vector(batch)
        cells = batch["cell"].to_numpy(zero_copy_only=False)
        ids, rows = batch["id"].to_numpy(zero_copy_only=False), matrix_of(batch["vector"])
        for c in np.unique(cells):
            own = cells == c
            best.add(ids[own], rows[own], probed[int(c)])

    return vectors.where(F.col("cell").isin(sorted(probed))), compare


def knn_cells(
    corpus: DataFrame,
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
    """Approximate search: each query meets the rows of its ``probes`` nearest cells only.

    Scores are exact. The cell filter prunes files of a corpus partitioned by cell, and a large
    cell is many files for many tasks, each of which passes on ``k`` hits per query. Cells are
    probed by the metric; ``where`` and ``fields`` are those of ``knn``.
    """
    metric = _check(metric, k)
    searched = corpus if where is None else corpus.where(where)
    vectors = searched.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(cell).alias("cell")
    )

    def scan(matrix):
        near = np.argsort(-_near(matrix, centroids, metric, probing=True), axis=1, kind="stable")[:, :probes]
        which = np.zeros((len(matrix), len(centroids)), bool)
        np.put_along_axis(which, near, True, axis=1)
        return cell_scan(vectors, which)

    hits = _search(queries.select("query_id", "vector"), k, metric, scan)
    return with_entity(hits, corpus, fields, id_col) if fields else hits


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: share of the exact hits that were found."""
    matched = exact.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return matched.groupBy("query_id").agg(
        (F.count("hit") / F.count("*")).alias("recall"), F.count("*").alias("k")
    )
