"""Token vectors to text vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions.columns import let
from litvec.functions.vector import MIN_WEIGHT

# The names of the poolings. How the mask (or any score) of a token becomes its weight.
_WEIGHTS: dict[str, Callable[[Column], Column]] = {
    "mean_pooling": lambda mask: mask,
    "attention_pooling": F.exp,
}

# Scores within a step have weights that a double holds with room for sums; rows without a score are in the lowest.
_STEP, _LOWEST = 256.0, -1e308


def weight_of(pooling: str) -> Callable[[Column], Column]:
    if not isinstance(pooling, str):
        raise TypeError(f"pooling must be a string: {type(pooling)}")
    if pooling not in _WEIGHTS:
        raise ValueError(f"pooling must be one of {sorted(_WEIGHTS)}: {pooling!r}")
    return _WEIGHTS[pooling]


def pool(
    token_vectors: DataFrame, *keys: str, vector: str = "vec", mask: str = "mask", pooling: str = "attention_pooling"
) -> DataFrame:
    """One vector per key: the weighted mean of its token vectors.

    ``mean_pooling`` weighs by the mask, ``attention_pooling`` by the softmax of the mask, or any
    score, over the rows of the key; padding counts only where a row says so, a null mask has no
    weight. Weighted vectors are summed as vectors, in every map task first; the weight rides
    along as one more dimension. Everything is read once.

    Scores of any size are fine: the sums of a key are kept per step of ``_STEP`` in the score, each
    relative to its step, and only sums of the two highest steps, brought to the highest one, can matter.
    """
    score = F.col(mask).cast("double")
    soft = pooling == "attention_pooling"
    step = F.coalesce(F.rint(score / _STEP - 0.5), F.lit(_LOWEST)) if soft else F.lit(0.0)
    weight = F.coalesce(weight_of(pooling)(score - step * _STEP if soft else score), F.lit(0.0))
    weighted = let(
        weight, lambda w: F.concat(F.transform(vector, lambda x: x.cast("double") * w), F.array(w))
    )
    rows = token_vectors.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], step.alias("step"), weighted.alias("w"))
    own = [f"key{i}" for i in range(len(keys))]
    sums = rows.groupBy(*own, *(["step"] if soft else [])).agg(Summarizer.sum(array_to_vector("w")).alias("total"))
    sums = sums.select(*[F.col(n).alias(k) for n, k in zip(own, keys)], *(["step"] if soft else []), vector_to_array("total").alias("t"))
    if soft:
        states = F.collect_list(F.struct("step", "t")).alias("states")
        sums = sums.groupBy(*keys).agg(states).select(*keys, let(F.col("states"), _merged).alias("t"))
    return sums.select(
        *keys,
        let(
            F.greatest(F.element_at("t", -1), F.lit(MIN_WEIGHT)),
            lambda w: F.transform(F.slice("t", 1, F.size("t") - 1), lambda x: x / w),
        ).alias(vector),
    )


def _merged(states: Column) -> Column:
    """The sum of states ``(step, t)`` in units of the highest step; what lies two steps below is beyond double precision."""

    def scaled(top: Column) -> Column:
        near = F.filter(states, lambda s: s["step"] >= top - 1)
        parts = F.transform(near, lambda s: F.transform(s["t"], lambda x: x * F.exp((s["step"] - top) * _STEP)))
        return F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            parts[0],
            lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
        )

    return let(F.array_max(F.transform(states, lambda s: s["step"])), scaled)


def pool_batch(token_vectors: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """The same for a batch of (texts, tokens, dim) that a model returned inside a task."""
    weight_of(pooling)
    mask = np.asarray(mask, dtype=np.float64)
    weights = np.exp(mask - mask.max(axis=1, keepdims=True)) if pooling == "attention_pooling" else mask
    total = np.einsum("btd,bt->bd", np.asarray(token_vectors, dtype=np.float64), weights)
    return total / np.maximum(weights.sum(axis=1, keepdims=True), MIN_WEIGHT)
