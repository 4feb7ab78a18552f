import hashlib
import math
import random

import pytest

from litvec.llm import clusters


def by_hand(rows, k, rounds, dim, scale=1024):
    kept = [
        (i, tuple(math.floor(scale * x) for x in v))
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[v for _, v in kept if near(v)[1] == i] for i in range(len(centroids))]
        centroids = [tuple(sum(x) // len(g) for x in zip(*g)) if g else c for g, c in zip(groups, centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == n) for n in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for i, c, d in found), key=str)


def found(spark, rows, schema="vec_id long, embedding array<float>", **kinds):
    df = spark.createDataFrame(rows, schema)
    out = clusters.with_inertia(*clusters.centroid_clusters(df, **kinds))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_whole_number_arithmetic(spark, seed):
    rnd = random.Random(seed)
    centres = [[rnd.randint(-8, 8) / 8 for _ in range(5)] for _ in range(6)]
    rows = [(i, [c + rnd.randint(-40, 40) / 128 for c in rnd.choice(centres)]) for i in range(200)]
    rows += [(i, list(rows[3][1])) for i in range(300, 380)]  # a crowd of equal vectors
    assert found(spark, rows, dim=5, clusters=4, rounds=6) == by_hand(rows, 4, 6, 5)


def test_left_out_vectors_ties_repeated_and_null_ids(spark):
    one, nan, inf = [0.5, -0.25], float("nan"), float("inf")
    rows = [(1, one), (1, one), (None, [0.0, 1.0]), (None, [2.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None])]
    rows += [(6, [nan, 0.0]), (7, [0.0, -inf]), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.5]), (10, [0.5, -1.0])]
    for k in (1, 2, 3, 20):
        assert found(spark, rows, dim=2, clusters=k, rounds=3) == by_hand(rows, k, 3, 2)


def test_empty_clusters_keep_their_centroid(spark):
    rows = [(i, [1.0]) for i in range(5)] + [(9, [3.0])]
    got = found(spark, rows, dim=1, clusters=6, rounds=2)
    assert got == by_hand(rows, 6, 2, 1)
    assert {r[1] for r in got if r[0] < 9} == {min(r[1] for r in got if r[0] < 9)}  # equal centroids: the smaller number


def test_empty_table_other_columns_and_large_components(spark):
    assert found(spark, []) == []
    wide = [(1, [0.5, 0.5], "a", 3), (2, [0.25, 1.0], "b", 4)]
    schema = "vec_id long, embedding array<double>, cluster string, v int"
    assert found(spark, wide, schema, dim=2, clusters=1) == by_hand([r[:2] for r in wide], 1, 10, 2)
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e30, 0.0])], dim=2)
