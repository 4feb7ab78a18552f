"""Word pieces by longest match over a vocabulary, so that limits count what a model counts.

The vocabulary is a table of ``piece, id``. Its trie is a table too: every beginning of a piece, with the
id where it is a piece. Tasks hold the trie, which is as small as the vocabulary, and cut each distinct
token of a batch once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions.columns import col
from litvec.functions.packing import Splitter

# Nodes of a trie that every task may hold; vocabularies of models have about a hundred thousand.
MOST_NODES = 4_000_000
UNKNOWN = "[UNK]"
# Characters of the texts that are cut at a time, a longer text alone.
_AT_ONCE = 4 << 20


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``piece, id`` of a file with one piece per line; the id is the number of the line from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("id", "piece"))
    return lines.where("piece <> ''").select("piece", "id")


def trie(vocabulary: DataFrame) -> DataFrame:
    """``prefix, id``: every beginning of every piece; the id is null where it is no piece. The smallest id wins."""
    ends = F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("n")
    beginnings = vocabulary.where(F.length("piece") > 0).select("piece", "id", ends)
    prefix = F.substring(F.col("piece"), F.lit(1), F.col("n"))
    own = F.when(F.col("n") == F.length("piece"), F.col("id"))
    return beginnings.select(prefix.alias("prefix"), own.cast("int").alias("id")).groupBy("prefix").agg(F.min("id").alias("id"))


@dataclass(frozen=True)
class WordPieces:
    """Cuts tokens into the longest pieces that the vocabulary has, from the left.

    A piece inside a word is looked up with ``inside`` before it, one that ends a word with ``end``
    behind it, one that starts a word with ``start`` before it. A token that cannot be cut to its end is one
    ``unknown`` piece. Tokens are lower-cased character by character unless ``lower`` is off.
    """

    nodes: dict[str, int | None] = field(repr=False)
    inside: str = "##"
    start: str = ""
    end: str = ""
    unknown: str = UNKNOWN
    lower: bool = True

    @staticmethod
    def of(vocabulary: DataFrame, most: int = MOST_NODES, **kinds) -> WordPieces:
        """From a vocabulary table. Its trie is counted first; more than ``most`` nodes raise."""
        rows = trie(vocabulary).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the vocabulary has more than {most} beginnings of pieces")
        return WordPieces({r["prefix"]: r["id"] for r in rows}, **kinds)

    def cut(self, token: str) -> list[tuple[int, int, str, int | None]]:
        """Start, end, key and id of the pieces of a token."""
        letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in token) if self.lower else token
        out, a, n = [], 0, len(letters)
        while a < n:
            key, best = self.inside if a else self.start, None
            for b in range(a + 1, n + 1):
                key += letters[b - 1]
                if key not in self.nodes:
                    break
                whole = key + self.end if b == n else key
                if self.nodes.get(whole) is not None:
                    best = (a, b, whole, self.nodes[whole])
            if best is None:
                return [(0, n, self.unknown, self.nodes.get(self.unknown))]
            out.append(best)
            a = best[1]
        return out

    def _cut_distinct(self, tokens: pa.Array) -> tuple[np.ndarray, list[list], list[str]]:
        coded = tokens.dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        return coded.indices.to_numpy(zero_copy_only=False), [self.cut(t.lstrip(" ")) for t in spelled], spelled

    def pieces(self, tokens: Column | str) -> Column:
        """Array of ``(piece, id)`` of an array of tokens; an id is null where the vocabulary has no unknown piece."""

        @F.arrow_udf("array<struct<piece:string,id:int>>")
        def found(lists: pa.Array) -> pa.Array:
            which, cuts, _ = self._cut_distinct(lists.flatten())
            counts = np.array([len(c) for c in cuts], dtype=np.int64)
            keys = [[p[2] for p in c] for c in cuts]
            ids = [[p[3] for p in c] for c in cuts]
            of_row = np.concatenate([[0], np.cumsum(counts[which])]) if len(which) else np.zeros(1, np.int64)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            offsets = of_row[np.concatenate([[0], np.cumsum(sizes)])]
            piece = pa.array([k for w in which for k in keys[w]], pa.string())
            number = pa.array([i for w in which for i in ids[w]], pa.int32())
            values = pa.StructArray.from_arrays([piece, number], ["piece", "id"])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=lists.is_null())

        return found(col(tokens))

    def _spelled(self, sentences: Column) -> Column:
        """Sentences as arrays of their pieces, spelled as in the source with the blank before a word."""

        @F.arrow_udf("array<array<string>>")
        def found(texts: pa.Array, lengths: pa.Array) -> pa.Array:
            ends = np.cumsum(np.nan_to_num(lengths.to_numpy(zero_copy_only=False)))
            cuts = np.flatnonzero(np.diff(ends // _AT_ONCE)) + 1
            parts = [texts.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(texts)])]
            return pa.concat_arrays([self._spelled_lists(p) for p in parts])

        lengths = F.aggregate(sentences, F.lit(0).cast("long"), lambda n, s: n + F.length(s))
        return found(F.transform(sentences, tx.token_pieces), lengths)

    def _spelled_lists(self, texts: pa.Array) -> pa.Array:
        sentences_of = texts.flatten()
        which, cuts, spelled = self._cut_distinct(sentences_of.flatten())
        parts = []
        for token, pieces in zip(spelled, cuts):
            blanks = len(token) - len(token.lstrip(" "))
            parts.append([token[(a + blanks if a else 0) : b + blanks] for a, b, _, _ in pieces])
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        of_token = np.concatenate([[0], np.cumsum(counts[which])]) if len(which) else np.zeros(1, np.int64)
        inner = np.concatenate([[0], np.cumsum(sentences_of.value_lengths().to_numpy(zero_copy_only=False))])
        outer_sizes = np.nan_to_num(texts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        outer = np.concatenate([[0], np.cumsum(outer_sizes)])
        # The pieces of each distinct token stand once, and are taken by their places.
        shift = (np.cumsum(counts) - counts)[which] - of_token[:-1]
        at = np.repeat(shift, counts[which]) + np.arange(of_token[-1])
        values = pa.array([p for of in parts for p in of], pa.string()).take(pa.array(at, pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array(of_token[inner.astype(np.int64)], pa.int32()), values)
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists, mask=texts.is_null())

    def splitter(self, sentences=tx.sentence_pieces) -> Splitter:
        """For chunks whose limit counts word pieces; one that a limit cuts inside a word goes on in the next chunk."""
        return Splitter(sentences, self._spelled)
