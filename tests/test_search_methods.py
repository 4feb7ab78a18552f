"""Joined, hashed, pruned and filtered search against the plain one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litvec import runtime
from litvec.functions import nearest
from litvec.operators import blocks, hashing, pruned, quantized, search


def frame(spark, vectors, name="id"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>, kind int")


def rows_of(hits):
    return [tuple(r) for r in hits.select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]


def clustered(seed, n, dim, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * 0.6


def gaps(vectors):
    bad = [None, [float("nan")] * vectors.shape[1], [None] + [1.0] * (vectors.shape[1] - 1), [float("inf")] * vectors.shape[1]]
    return [*vectors.tolist(), *bad]


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_joined_blocks_of_any_size(spark, metric):
    vectors = clustered(1, 300, 6)
    vectors[50:150] = vectors[49]  # copies tie, the smaller id first
    corpus = frame(spark, gaps(vectors))
    asked = frame(spark, gaps(vectors[::9] + 0.01), "query_id")
    exact = rows_of(search.knn(corpus, asked, 7, metric))
    for block in (3000, 1 << 20):
        assert rows_of(blocks.knn_joined(corpus, asked, 7, metric, block_bytes=block)) == exact
    some = blocks.knn_joined(corpus, asked, 2, metric, where="kind = 1", fields=("kind", "none"))
    assert {r.entity.kind for r in some.collect()} == {1}
    assert rows_of(some) == rows_of(search.knn(corpus, asked, 2, metric, where="kind = 1"))


def test_joined_reads_its_corpus_once_and_takes_empty_sides(spark):
    corpus, asked = frame(spark, np.eye(4)), frame(spark, np.eye(4), "query_id")
    assert blocks.knn_joined(corpus.limit(0), asked).count() == 0 == blocks.knn_joined(corpus, asked.limit(0)).count()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    lazy = corpus.mapInArrow(counted, corpus.schema)
    assert blocks.knn_joined(lazy, asked, 1, block_bytes=1).count() == 4 and read.value == 4


def test_many_small_blocks_grow_instead_of_copying_rows(spark):
    vectors = clustered(5, 600, 4)
    rows, asked = frame(spark, vectors), frame(spark, vectors[:40], "query_id")
    passed = blocks.block_join(rows, asked, (), 1, "L2", 4, block_bytes=1)
    assert passed.count() <= 40 * blocks.SIDE_BLOCKS  # a hit per question and block of rows
    assert rows_of(blocks.knn_joined(rows, asked, 3, "L2", block_bytes=1)) == rows_of(search.knn(rows, asked, 3, "L2"))


def test_candidates_of_a_large_block_are_reduced_on_the_way(monkeypatch):
    monkeypatch.setattr(nearest, "_BUFFERED", 1000)
    rng = np.random.default_rng(8)
    corpus, asked = rng.normal(size=(30_000, 8)), rng.normal(size=(500, 8))
    most, reduce = [0], nearest.Best._reduce

    def watched(best):
        most[0] = max(most[0], best.buffered)
        reduce(best)

    monkeypatch.setattr(nearest.Best, "_reduce", watched)
    best = nearest.Best(asked, 5, "L2")
    best.add(np.arange(len(corpus)), corpus)
    hits = best.hits(pa.array(range(500)))
    distances = np.linalg.norm(corpus[None] - asked[:50, None], axis=2)
    nearest_ids = np.argsort(distances, axis=1, kind="stable")[:, :5]
    assert hits["id"].to_numpy()[:250].tolist() == nearest_ids.ravel().tolist()
    assert most[0] < 20_000


def test_hashed_search_finds_most_and_scores_exactly(spark):
    vectors = clustered(2, 3000, 16, 60)
    corpus, asked = frame(spark, gaps(vectors)), frame(spark, gaps(vectors[::30] + 0.05), "query_id")
    exact = search.knn(corpus, asked, 10)
    found = hashing.knn_hashed(corpus, asked, 10)
    assert search.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    scores = {(q, i): s for q, _, i, s in rows_of(search.knn(corpus, asked, 3004))}
    assert all(scores[q, i] == s for q, _, i, s in rows_of(found))
    shares = [
        search.recall(hashing.knn_hashed(corpus, asked, 10, tables=t, probes=p), exact).agg(F.avg("recall")).first()[0]
        for t, p in ((1, 0), (3, 2))
    ]
    assert shares == sorted(shares) and shares[0] < 1
    small = hashing.knn_hashed(corpus, asked, 10, block_bytes=20_000)
    assert rows_of(small) == rows_of(found)


def test_a_bucket_of_equal_vectors_is_cut_into_blocks(spark):
    vectors = np.ones((400, 4))
    corpus, asked = frame(spark, vectors), frame(spark, vectors[:90], "query_id")
    hits = rows_of(hashing.knn_hashed(corpus, asked, 3, tables=2, probes=1, block_bytes=3000))
    assert [h[2] for h in hits] == [0, 1, 2] * 90


def test_codes_name_sides_of_planes(spark):
    vectors = np.array([[1.0, 0.0, 0.5], [-1.0, 2.0, 0.0]])
    normals = hashing.planes(3, 2, 4)
    got = [r.c for r in frame(spark, gaps(vectors)).orderBy("id").select(hashing.codes("vector", 3, 2, 4, 1).alias("c")).collect()]
    assert got[2:] == [None] * 4
    for v, row in zip(vectors, got):
        sides = normals @ v
        own = [sum(1 << b for b in range(4) if sides[t, b] >= 0) + 16 * t for t in range(2)]
        turned = [own[t] ^ (1 << int(np.argmin(np.abs(sides[t])))) for t in range(2)]
        assert row == own + turned
    with pytest.raises(ValueError):
        hashing.codes("vector", 3, 2, 4, 5)


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_pruned_search_is_exact_and_reads_less(spark, metric):
    vectors = clustered(3, 1500, 8, 30)
    corpus = frame(spark, gaps(vectors))
    asked = frame(spark, gaps(vectors[::50] + 0.02), "query_id")
    centroids = search.fit_cells(corpus, 30, metric=metric)
    celled = search.assign_cells(corpus, centroids, metric=metric)
    bounds = pruned.cell_bounds(celled, centroids, metric)
    assert bounds.agg(F.sum("n")).first()[0] == 1500
    for k, where in ((1, None), (8, "kind = 2"), (2000, None)):
        report = []
        found = pruned.knn_pruned(celled, asked, centroids, bounds, k, metric, where, report=report)
        assert rows_of(found) == rows_of(search.knn(corpus, asked, k, metric, where))
        if k == 1 and metric != "IP":
            assert report[0]["rows"] < 0.5 * report[0]["of_rows"]


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
def test_filtered_cells_never_miss_hits(spark, metric):
    vectors = clustered(4, 900, 8, 20)
    corpus = frame(spark, gaps(vectors))
    asked = frame(spark, vectors[::90], "query_id")
    centroids = search.fit_cells(corpus, 20, metric=metric)
    celled = search.assign_cells(corpus, centroids, metric=metric)
    for where, rows in (("id in (5, 77, 801)", 3), ("id = 900", 0), ("kind = 1 and id < 60", 8), (None, 8)):
        found = pruned.knn_filtered_cells(celled, asked, centroids, 1, 8, metric, where)
        assert {r["count"] for r in found.groupBy("query_id").count().collect()} <= {rows} and found.count() == 10 * rows
    few = search.knn_cells(celled, asked, centroids, 1, 8, metric, where="id in (5, 77, 801)")
    assert few.count() < 30


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_compressed_search_finds_most_and_reads_little(spark, tmp_path, metric):
    vectors = clustered(5, 2000, 32, 40)
    corpus = frame(spark, gaps(vectors))
    asked = frame(spark, gaps(vectors[::100] + 0.03), "query_id")
    books = quantized.fit_codebooks(corpus, 8, 64, metric)
    quantized.save_codebooks(spark, books, str(tmp_path / "books"))
    books = quantized.load_codebooks(spark, str(tmp_path / "books"))
    quantized.compress(corpus, books, metric).coalesce(1).write.parquet(str(tmp_path / "codes"))
    corpus.select("id", "vector").coalesce(1).write.parquet(str(tmp_path / "vectors"))
    small, large = (runtime.bytes_under(spark, str(tmp_path / f)) for f in ("codes", "vectors"))
    assert small < large / 5
    codes = spark.read.parquet(str(tmp_path / "codes"))
    assert codes.count() == 2000 and codes.selectExpr("max(length(code))").first()[0] == 8
    exact = search.knn(corpus, asked, 10, metric)
    found = quantized.knn_quantized(corpus, codes, asked, books, 10, metric, rerank=10)
    assert search.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert rows_of(quantized.knn_quantized(corpus, codes, asked, books, 10, metric, rerank=200)) == rows_of(exact)
    some = quantized.knn_quantized(corpus, codes, asked, books, 3, metric, rerank=1000, where="id % 7 = 1", fields=("kind",))
    assert rows_of(some) == rows_of(search.knn(corpus, asked, 3, metric, "id % 7 = 1"))


def test_compressed_search_of_nothing(spark):
    empty = frame(spark, gaps(np.zeros((0, 2))))
    books = quantized.fit_codebooks(empty, 2)
    codes = quantized.compress(empty, books)
    assert codes.count() == 0
    assert quantized.knn_quantized(empty, codes, frame(spark, np.eye(2), "query_id"), books).count() == 0
    with pytest.raises(ValueError):
        quantized.fit_codebooks(empty, codes=300)


def test_centroids_are_fitted_on_a_bounded_sample(spark):
    corpus = frame(spark, clustered(6, 1000, 4, 5))
    centroids = search.fit_cells(corpus, 5, per_cell=20)
    assert centroids.shape == (5, 4)
    assert search.assign_cells(corpus, centroids).where("cell is null").isEmpty()
