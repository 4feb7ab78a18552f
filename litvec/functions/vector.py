"""Vector arithmetic as columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litvec.functions.columns import col, let
from litvec.functions.nearest import MIN_NORM
from litvec.functions.text import MARK

# Fixed value: smallest divisor used when averaging.
MIN_WEIGHT = 1e-9


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def l2_normalize(vector: Column | str) -> Column:
    vector = col(vector)
    return let(
        F.greatest(norm(vector), F.lit(MIN_NORM)),
        lambda n: F.transform(vector, lambda x: x.cast("double") / n),
    )


def parse_vector(text: Column | str) -> Column:
    """Vector written as text, such as ``[0.1, -2e-3]``."""
    return F.from_json(col(text), "array<double>")


def bucket_of(token: str, dim: int) -> int:
    """The first seven hex digits of the md5 of a token, modulo ``dim``; no bucket for an empty one."""
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % dim if token else -1


def hash_vector(text: Column | str, dim: int) -> Column:
    """Counts of the lower-case tokens per bucket as a vector of unit length.

    Needs no model and sees the whole text; a null text has no vector. Tokens are those of ``tokens``, found here by setting
    every mark apart and splitting at white space: a batch of texts at once, in Arrow, so that Python
    only sees each distinct token of a batch.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def counted(texts: pa.Array) -> pa.Array:
        n = len(texts)
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=rf"({MARK})", replacement=r" \1 ")
        lists = pc.utf8_split_whitespace(apart)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n, dtype=np.int64), lengths)
        coded = lists.flatten().dictionary_encode()
        buckets = np.array([bucket_of(t, dim) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        bucket = buckets[coded.indices.to_numpy(zero_copy_only=False)]
        cell = (row * dim + bucket)[bucket >= 0]
        counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
        counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), MIN_NORM)
        offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
        values = pa.array(counts.ravel().astype(np.float32))
        return pa.ListArray.from_arrays(offsets, values, mask=texts.is_null())

    return counted(col(text))
