import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litvec.functions import vector as vec
from litvec.operators import embedding, pooling, projection


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    out = [r[0] for r in df.select(vec.l2_normalize("v")).collect()]
    assert out == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], None]


def test_vector_from_text(spark):
    df = spark.createDataFrame([("[0.1, -2e-3, 3]",), ("[]",)], "t string")
    assert [r[0] for r in df.select(vec.parse_vector("t")).collect()] == [[0.1, -0.002, 3.0], []]


def test_hash_vector(spark):
    text = "Gene, gene expression"
    df = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, text.upper())], "i int, t string")
    rows = {r.i: r.v for r in df.select("i", vec.hash_vector("t", 16).alias("v")).collect()}
    counts = np.zeros(16)
    for token in ("gene", ",", "gene", "expression"):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % 16] += 1
    assert rows[0] == pytest.approx((counts / np.linalg.norm(counts)).tolist())
    assert rows[1] == [0.0] * 16 and rows[2] is None and rows[3] == rows[0]


def masked(spark):
    rows = [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 1, [5.0, 9.0]), (1, 0, [100.0, 0.0]), (1, 0, [0.0, 100.0]),
            (2, 0, [7.0, 7.0]), (2, 0, [1.0, 1.0]), (3, 1, [2.0, -2.0])]
    return spark.createDataFrame(rows, "text_id int, mask int, vec array<float>")


def test_mean_pooling(spark):
    out = {r.text_id: r.vec for r in pooling.pool(masked(spark), "text_id", pooling="mean_pooling").collect()}
    assert out == {1: pytest.approx([3.0, 5.0]), 2: [0.0, 0.0], 3: pytest.approx([2.0, -2.0])}


def test_attention_pooling_weighs_padding(spark):
    real, padding = 0.267683, 0.098475
    out = {r.text_id: r.vec for r in pooling.pool(masked(spark), "text_id").collect()}
    assert out[1] == pytest.approx([9 * real + 100 * padding, 15 * real + 100 * padding], rel=1e-4)
    assert out[2] == pytest.approx([4.0, 4.0])


@pytest.mark.parametrize("name", ["mean_pooling", "attention_pooling"])
def test_batch_pooling_equals_the_grouped_one(spark, name):
    rng = np.random.default_rng(1)
    vectors, mask = rng.normal(size=(5, 7, 3)), rng.integers(0, 2, size=(5, 7))
    rows = [(t, int(mask[t, p]), vectors[t, p].tolist()) for t in range(5) for p in range(7)]
    df = spark.createDataFrame(rows, "text_id int, mask int, vec array<double>")
    grouped = pooling.pool(df, "text_id", pooling=name).orderBy("text_id").collect()
    assert np.allclose([r.vec for r in grouped], pooling.pool_batch(vectors, mask, name))


def test_pooling_names():
    with pytest.raises(ValueError):
        pooling.weight_of("max_pooling")
    with pytest.raises(TypeError):
        pooling.weight_of(None)


def test_model_is_loaded_once_per_worker_and_vectors_are_unit(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.range(100, numPartitions=40).select(F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text"))
    rows = embedding.embed(df, load, batch_size=7).collect()
    assert 1 <= len(log.read_text()) < 40  # by worker process, not by task
    for r in rows:
        n = len(r.text)
        assert r.vector == pytest.approx([n / math.hypot(n, 1), 1 / math.hypot(n, 1)], rel=1e-6)


def test_truncate_and_mask(spark):
    df = spark.createDataFrame([(1, "a", "x y z"), (2, "a", "x"), (3, "b", "x y"), (4, "a", "")], "i int, doc string, text string")
    per_batch = embedding.truncate_mask(df, max_tokens=2, batch="doc").orderBy("i").collect()
    assert [(r.tokens, r["mask"]) for r in per_batch] == [
        (["x", "y"], [1, 1]), (["x"], [1, 0]), (["x", "y"], [1, 1]), ([], [0, 0]),
    ]
    fixed = embedding.truncate_mask(df.where("i = 2"), max_tokens=4).first()
    assert fixed["mask"] == [1, 0, 0, 0]


def test_projection_equals_principal_components(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, "ab"[i % 2], p.tolist()) for i, p in enumerate(points)], "id int, label string, vector array<double>")
    rows = projection.project_2d(df, "id", "label").orderBy("id").collect()
    found = np.array([[r.x, r.y] for r in rows])
    _, _, axes = np.linalg.svd(points - points.mean(0))
    expected = points @ axes[:2].T
    assert np.allclose(np.abs(found), np.abs(expected))
    assert [r.code for r in rows[:2]] == [0, 1]
    assert tuple(projection.vector_shape(df).first()) == (60, 5, 5)


def test_one_scan_and_scores_of_any_size(spark):
    rows = [
        (1, 0.0, [1.0, 5.0]), (1, 1.0, [3.0, 7.0]), (1, None, [9.0, 9.0]),
        (2, 1e300, [1.0, 2.0]), (2, -1e300, [5.0, 5.0]), (2, 1e300, [3.0, 2.0]),
        (3, 700.0, [1.0, 1.0]), (3, 701.0, [2.0, 4.0]), (3, -700.0, [9.0, 9.0]), (3, 128.0, [1.0, 0.0]), (3, 127.9, [0.0, 1.0]),
        (None, 4.0, [2.0, 2.0]), (None, 4.0, [4.0, 2.0]), (5, None, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "total long, mask double, vec array<double>").repartition(4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pooled = pooling.pool(df.mapInArrow(counted, df.schema), "total")
    assert read.value == 0  # nothing runs while the plan is built
    got = {r.total: r.vec for r in pooled.collect()}
    assert read.value == len(rows)
    e = np.e
    assert got[1] == pytest.approx([(1 + 3 * e) / (1 + e), (5 + 7 * e) / (1 + e)])
    assert got[2] == [2.0, 2.0] and got[None] == [3.0, 2.0] and got[5] == [0.0, 0.0]
    assert got[3] == pytest.approx([(1 + 2 * e) / (1 + e), (1 + 4 * e) / (1 + e)])
