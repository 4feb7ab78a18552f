"""Vectors to points of a plane, with the code of their label."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.operators.ids import encode_labels


def vector_shape(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Number of vectors and their smallest and largest length."""
    size = F.size(vector)
    return df.agg(
        F.count(vector).alias("n_rows"),
        F.min(size).cast("long").alias("min_dim"),
        F.max(size).cast("long").alias("max_dim"),
    )


def project_2d(df: DataFrame, id_col: str, label: str, vector: str = "vector") -> DataFrame:
    """First two principal components of the vectors: ``(id, x, y, label, code)``.

    The driver sees the covariance matrix only, dim x dim numbers.
    """
    featured = df.select(id_col, label, array_to_vector(F.col(vector)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="point").fit(featured)
    points = model.transform(featured).withColumn("p", vector_to_array("point"))
    placed = points.select(id_col, label, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return encode_labels(placed, label)
