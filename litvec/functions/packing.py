"""Greedy packing of sentences into chunks of bounded token count, inside one row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from litvec.functions.columns import col, let
from litvec.functions.text import sentence_pieces, token_pieces

_SPANS = "array<struct<start:int,len:int>>"
# Sentences folded before their spans are set aside: the growing list that each step copies stays short.
_FOLD = 512


def fixed_slices(items: Column | str, n: int) -> Column:
    """Consecutive slices of ``n`` elements, the last one possibly shorter; none for an empty array."""
    if n < 1:
        raise ValueError(f"slice size must be positive: {n}")
    items = col(items)
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(n))
    return F.when(
        F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(n)))
    ).otherwise(F.slice(F.array(items), 1, 0))


def _span(start: Column, length: Column) -> Column:
    return F.struct(start.alias("start"), length.alias("len"))


def _step(max_tokens: int):
    none = F.array().cast(_SPANS)

    def after(spans: Column, start: Column, length: Column) -> Column:
        return F.struct(spans.alias("spans"), start.alias("start"), length.alias("len"))

    def step(state: Column, n: Column) -> Column:
        behind = state["start"] + state["len"]
        flushed = F.when(state["len"] > 0, F.array(_span(state["start"], state["len"]))).otherwise(none)
        cuts = F.transform(
            F.sequence(F.lit(0), n - 1, F.lit(max_tokens)),
            lambda i: _span(behind + i, F.least(F.lit(max_tokens), n - i)),
        )
        return (
            F.when(state["len"] + n <= max_tokens, after(state["spans"], state["start"], state["len"] + n))
            .when(n > max_tokens, after(F.concat(state["spans"], flushed, cuts), behind + n, F.lit(0)))
            .otherwise(after(F.concat(state["spans"], flushed), behind, n))
        )

    return step


def pack_spans(sizes: Column, max_tokens: int) -> Column:
    """Token spans ``(start, len)`` of the chunks, from the token counts of the sentences.

    Sentences are added while they fit. One longer than ``max_tokens`` is cut, and each of its
    cuts, the short last one too, is a chunk of its own.
    """
    if max_tokens < 1:
        raise ValueError(f"max_tokens must be positive: {max_tokens}")
    none = F.array().cast(_SPANS)
    step = _step(max_tokens)

    def fold(state: Column, block: Column) -> Column:
        opening = F.struct(none.alias("spans"), state["start"].alias("start"), state["len"].alias("len"))
        inner = F.aggregate(F.slice(sizes, block + 1, F.lit(_FOLD)), opening, step)
        return let(
            inner,
            lambda done: F.struct(
                F.concat(state["done"], F.array(done["spans"])).alias("done"),
                done["start"].alias("start"),
                done["len"].alias("len"),
            ),
        )

    def finish(state: Column) -> Column:
        rest = F.when(state["len"] > 0, F.array(_span(state["start"], state["len"]))).otherwise(none)
        return F.concat(F.flatten(state["done"]), rest)

    blocks = F.when(
        F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(_FOLD))
    ).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        F.array().cast(f"array<{_SPANS}>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("len")
    )
    return F.aggregate(blocks, start, fold, finish)


@dataclass(frozen=True)
class Splitter:
    """How a text is cut: into sentences, and these into the pieces that a chunk counts.

    Both keep the blank before what they cut off, so that joined pieces are the single-spaced text.
    ``pieces`` takes the array of sentences and may be a vectorised Python function.
    """

    sentences: Callable[[Column | str], Column] = sentence_pieces
    pieces: Callable[[Column], Column] = lambda s: F.transform(s, token_pieces)


PLAIN = Splitter()


def chunks(text: Column | str, max_tokens: int, splitter: Splitter = PLAIN) -> Column:
    """Array of ``(text, n_tokens)``: whole sentences where they fit, spelled as in the source."""

    def from_sentences(pieces: Column) -> Column:
        def spans(flat: Column) -> Column:
            total = F.size(flat)
            sizes = F.transform(pieces, lambda p: F.size(p))
            return F.when(
                (total > 0) & (total <= max_tokens), F.array(_span(F.lit(0), total))
            ).otherwise(let(sizes, lambda n: pack_spans(n, max_tokens)))

        def chunk(flat: Column, span: Column) -> Column:
            words = F.slice(flat, span["start"] + 1, span["len"])
            return F.struct(
                F.btrim(F.array_join(words, ""), F.lit(" ")).alias("text"), span["len"].alias("n_tokens")
            )

        return let(F.flatten(pieces), lambda flat: F.transform(spans(flat), lambda span: chunk(flat, span)))

    return let(splitter.pieces(splitter.sentences(text)), from_sentences)
