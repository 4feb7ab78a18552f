"""Texts to vectors: by a model the caller supplies, or by the built-in hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions.nearest import MIN_NORM
from litvec.functions.subwords import WordPieces
from litvec.functions.vector import hash_vector
from litvec.operators.pooling import pool_batch, weight_of
from litvec.runtime import small_side, stage

# Most tokens a model takes per text; size of the vectors of the demo configuration.
MAX_MODEL_TOKENS = 512
DEMO_DIM = 768

Model = Callable[[list[str]], np.ndarray | tuple[np.ndarray, np.ndarray]]

_models: dict[str, Model] = {}


def _kept_model(call: str, load_model: Callable[[], Model]) -> Model:
    """The model of this call of ``embed``, loaded once by each worker process."""
    if call not in _models:
        _models.clear()
        _models[call] = load_model()
    return _models[call]


def embed(
    df: DataFrame,
    load_model: Callable[[], Model],
    text: str = "text",
    vector: str = "vector",
    pooling: str = "attention_pooling",
    batch_size: int = 64,
) -> DataFrame:
    """Add unit vectors made by a model.

    ``load_model`` runs once per worker process, which keeps the model of the last call, and returns a function from texts to a matrix (texts, dim),
    or to a pair of token vectors (texts, tokens, dim) and mask, which is then pooled. A batch
    holds ``batch_size`` texts of one task; a model whose padding must not matter masks it.
    """
    weight_of(pooling)
    call = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _kept_model(call, load_model)
        for batch in batches:
            out = []
            for at in range(0, len(batch), batch_size):
                result = model(batch.iloc[at : at + batch_size].tolist())
                matrix = pool_batch(*result, pooling) if isinstance(result, tuple) else np.asarray(result)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                out.extend((matrix / np.maximum(norms, MIN_NORM)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return df.withColumn(vector, encode(text))


def hash_embed(df: DataFrame, dim: int, text: str = "text", vector: str = "vector") -> DataFrame:
    """Add unit vectors of hashed token counts."""
    return df.withColumn(vector, hash_vector(text, dim))


def truncate_mask(
    df: DataFrame, text: str = "text", max_tokens: int = MAX_MODEL_TOKENS, batch: str | None = None
) -> DataFrame:
    """Model input form of texts: at most ``max_tokens`` tokens and a 1/0 mask with padding.

    Masks are padded to the longest text of the same ``batch`` value, null being one, or to
    ``max_tokens``. A null text has no tokens.
    """
    return _masked(df.withColumn("tokens", F.coalesce(tx.tokens(text), F.array().cast("array<string>"))), max_tokens, batch)


def truncate_subwords(
    df: DataFrame, pieces: WordPieces, text: str = "text", max_tokens: int = MAX_MODEL_TOKENS, batch: str | None = None
) -> DataFrame:
    """The same with word pieces for tokens: ``tokens`` holds the pieces, ``ids`` their numbers in the vocabulary.

    The limit counts pieces, as models do, so a text of long or rare words is cut earlier. A null
    text has no pieces.
    """
    none = F.array().cast("array<struct<piece:string,id:int>>")
    cut = df.withColumn("_pieces", F.slice(F.coalesce(pieces.pieces(tx.tokens(text)), none), 1, max_tokens))
    named = cut.withColumns({"tokens": F.col("_pieces.piece"), "ids": F.col("_pieces.id")}).drop("_pieces")
    return _masked(stage(named, "subwords") if batch is not None else named, max_tokens, batch)


def _masked(found: DataFrame, max_tokens: int, batch: str | None) -> DataFrame:
    """Cut ``tokens`` and add the mask, padded to the longest of the batch."""
    cut = found.withColumn("tokens", F.slice("tokens", 1, max_tokens)).withColumn("_n", F.size("tokens"))
    if batch is None:
        padded = cut.withColumn("_to", F.lit(max_tokens))
    else:
        longest = found.groupBy(F.col(batch).alias("_batch")).agg(
            F.least(F.max(F.size("tokens")), F.lit(max_tokens)).alias("_to")
        )
        padded = cut.join(small_side(longest, "longest"), F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    mask = F.concat(
        F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_to") - F.col("_n"))
    )
    return padded.withColumn("mask", mask).drop("_n", "_to")
