"""One key holds a third of all rows: results stay whole, and the key is spread or reduced first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litvec.operators import dedupe, ids, passages, pooling, search

N = 30_000


@pytest.fixture(scope="module")
def rows(spark):
    """Row number, its document, its position there, and a few values; document 0 has a third of the rows."""
    n = F.col("id")
    hot = n < N // 3
    return spark.range(N).select(
        n.alias("row"),
        F.when(hot, 0).otherwise(1 + n % 1000).alias("doc"),
        F.when(hot, n).otherwise((n - N // 3) / 1000).cast("long").alias("index"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("text "), n % 5000)).alias("text"),
        F.lit("abstract").alias("section"),
    ).repartition(8)


def test_collapse_spreads_a_hot_document(spark, rows):
    whole = passages.collapse(rows.drop("text", "row"), ("doc",), sentence="index", part_size=1000)
    hot = whole.where("doc = 0").collect()
    assert [(r.n_passages, r.text) for r in hot] == [(N // 3, " ".join(map(str, range(N // 3))))]
    assert whole.agg(F.sum("n_passages")).first()[0] == N


def test_dedupe_reduces_copies_in_the_map_tasks(spark, rows):
    kept = dedupe.dedupe_text(rows, "row", "text", "section")
    expected = rows.groupBy("text").agg(F.min("row").alias("row"))
    assert kept.select("row").exceptAll(expected.select("row")).count() == 0
    assert kept.count() == expected.count() == 5001


def test_latest_of_a_hot_id(spark, rows):
    found = dedupe.latest_per_id(rows.select("doc", "row", "text"), "doc", "row")
    assert tuple(found.where("doc = 0").first()) == (0, 0, "hot")
    assert found.count() == 1001


def test_dense_ids_split_a_hot_leading_key(spark, rows):
    numbered = ids.dense_ids(rows.select("doc", "index", "row"), "doc", "index", "row")
    first, last, distinct, n = numbered.agg(
        F.min("id"), F.max("id"), F.countDistinct("id"), F.count("*")
    ).first()
    assert (first, last, distinct, n) == (0, N - 1, N, N)
    assert numbered.where("doc = 0 and id <> index").count() == 0
    sizes = rows.repartitionByRange(4, "doc", "index").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < N / 2


def test_hot_label(spark, rows):
    coded = ids.encode_labels(rows.select("row", "text"), "text")
    assert coded.count() == N and coded.where("text = 'hot'").select("code").distinct().count() == 1
    assert "SortMergeJoin" not in coded._jdf.queryExecution().executedPlan().toString()


def test_hot_text_is_pooled_in_map_tasks(spark, rows):
    vectors = rows.select("doc", F.array("index", F.lit(1)).cast("array<float>").alias("vec"), F.lit(1).alias("mask"))
    pooled = pooling.pool(vectors, "doc", pooling="mean_pooling")
    assert pooled.where("doc = 0").first().vec == pytest.approx([(N // 3 - 1) / 2, 1.0])
    text = pooled._jdf.queryExecution().executedPlan().toString()
    assert text.count("ObjectHashAggregate") == 2


def test_copies_of_one_vector_fill_a_cell(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 8))
    vectors[:1000] = vectors[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    corpus = corpus.repartition(8)
    query = corpus.where("id = 0").select(F.col("id").alias("query_id"), "vector")
    centroids = search.fit_cells(corpus, 6)
    for hits in (
        search.knn(corpus, query, 50),
        search.knn_cells(search.assign_cells(corpus, centroids), query, centroids, 2, 50),
    ):
        rows = hits.orderBy("rank").collect()
        assert [r.id for r in rows] == list(range(50)) and {r.score for r in rows} == {1.0}
