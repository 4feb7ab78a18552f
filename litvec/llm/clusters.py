"""k-means over integer vectors in column expressions: the same result on every cluster, to the last digit.

Vectors become whole numbers once. Distances to the few centroids are expressions over literal
arrays, the nearest one is the least struct of distance and number, and the new centroids come from
column sums, so neither the order of rows nor the number of tasks can change a digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.runtime import stage

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
# Components up to this size have distances that fit a long: 64 squares of differences below 2^28.
LARGEST = 1 << 27

Centroids = list[list[int]]


def whole_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE
) -> DataFrame:
    """``vec_id`` and ``v``, the vector as ``floor(scale * x)`` of every component.

    Only vectors of exactly ``dim`` components stay, none of them null, NaN or infinite; others and
    null vectors are left out. A component beyond ``LARGEST`` fails the job, as its distance may
    not fit a long. Other columns are left out.
    """
    good = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wrong = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("long")

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x
        return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled)).otherwise(wrong)

    given = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return given.where(F.col("v").isNotNull() & good).select("vec_id", F.transform("v", whole).alias("v"))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> Centroids:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; ties by the vector, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.orderBy(key.asc_nulls_last(), "v").limit(clusters).select("v").collect()]


def distance(v: Column, centroid: Sequence[int]) -> Column:
    """Squared distance of a vector to a literal one."""
    there = F.lit([int(c) for c in centroid]).cast("array<bigint>")
    squares = F.zip_with(v, there, lambda x, c: (x - c) * (x - c))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square)


def nearest(v: Column, centroids: Centroids) -> Column:
    """Struct of ``distance`` and ``cluster`` of the nearest centroid, ties to the smaller number."""
    return F.array_min(
        F.array(*[F.struct(distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)])
    )


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Floors of the exact means of the clusters; a centroid without vectors stays.

    One row per cluster comes to the driver: the sums of its columns and its size.
    """
    dim = len(centroids[0])
    assigned = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    columns = assigned.select("cluster", *[F.col("v")[i].alias(f"x{i}") for i in range(dim)])
    sums = columns.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)])
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r["cluster"]] = [r[f"x{i}"] // r["n"] for i in range(dim)]
    return out


def centroid_clusters(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, Centroids]:
    """``vec_id, cluster, distance`` of every kept vector, and the final centroids.

    Each round reads the staged whole numbers once and brings ``clusters`` rows to the driver,
    however many vectors there are; nothing but these sums is shuffled, so equal vectors need no
    special care. Rounds end early when no centroid moved, as all later ones would be the same.
    Rows that repeat an id are separate vectors, a null id stays null. With fewer vectors than
    clusters there are fewer clusters, and an empty table has none.
    """
    vectors = stage(whole_vectors(df, vec_id, vector, dim, scale), "whole-vectors")
    centroids = seeds(vectors, clusters, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        before, centroids = centroids, moved(vectors, centroids)
        if centroids == before:
            break
    found = vectors.select("vec_id", nearest(F.col("v"), centroids).alias("near"))
    return found.select("vec_id", "near.cluster", "near.distance"), centroids


def with_inertia(found: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds the sum of distances within the cluster and over all, and the digest of the centroid.

    The rows are staged, as they are read twice; one sum per cluster comes to the driver.
    """
    staged = stage(found, "clusters")
    sums = {r["cluster"]: r["n"] for r in staged.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    number = F.col("cluster") + 1
    per_cluster = F.lit([sums.get(i, 0) for i in range(len(centroids))] or [0]).cast("array<bigint>")
    return staged.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(per_cluster, number).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(F.lit(digests or [""]).cast("array<string>"), number).alias("centroid_sha256"),
    )
