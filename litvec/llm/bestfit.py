"""Best-fit decreasing: documents as token ids, packed into few sequences of one window.

Documents are cut only where they are longer than a window. Their pieces are dealt to groups of
bounded size; in a group they come by decreasing length, and each goes to the open sequence with
the least room that still holds it, found by a segment tree over the room that is left.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.llm.words import in_slices
from litvec.runtime import stage

WINDOW = 2048
END_ID = 0
GROUP = 1 << 15  # pieces packed together
_BIN_BITS = 33

# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary file.

    Where the file is plain (merges in the order of their ids, the usual pattern, no normaliser),
    the same merges run as ranks, which takes a quarter of the time. A few trial texts must agree.
    Texts that the faster way refuses, as runs of a million blanks, go through the file's own tokenizer.
    """

    _TRIAL = ("It's 12 o'clock,  don't\n\n go\t. ", "<|endoftext|>a <|endoftext|>", "日本語 ñandú ́  x  ", "\x00\x85 !? '")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = self._as_ranks(path)
        if self.ranks and not all(np.array_equal(self._slow(t), self._fast(t)) for t in self._TRIAL):
            self.ranks = None

    @staticmethod
    def _as_ranks(path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        vocabulary = model.get("vocab")
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(model.get(k) for k in ("byte_fallback", "ignore_merges"))
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and spec.get("normalizer") is None
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            return None
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in added}
        ids = [vocabulary[j] for j in joined]
        if ids != sorted(set(ids)) or len(vocabulary) - len(special.keys() & vocabulary.keys()) != 256 + len(ids):
            return None
        from tokenizers import pre_tokenizers

        import tiktoken

        # Printable bytes stand for themselves, the others for the next free characters, in order.
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        letters = {c: ord(c) for c in alphabet if ord(c) < 256}
        others = (b for b in range(256) if chr(b) not in letters)
        letters |= dict(zip((c for c in alphabet if ord(c) >= 256), others))
        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _fast(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None:
            return self._slow(text)
        try:
            return self._fast(text)
        except ValueError:
            return self._slow(text)


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


class TightestFit:
    """Open sequences by the room they have left: a segment tree whose leaf ``r`` counts those with room ``r``.

    ``place`` finds the smallest room that holds a length, climbing from the leaf of the length to
    the first node with an open sequence to the right and descending to its leftmost leaf.
    """

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.sequences = 0

    def _count(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.tree[node] += change
            node >>= 1

    def _tightest(self, length: int) -> int | None:
        node = self.size + length
        while not self.tree[node]:
            while node & 1:  # a right child: what lies further right is under an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.size

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece of this length."""
        room = self._tightest(length)
        if room is None:
            room, sequence = self.window, self.sequences
            self.sequences += 1
        else:
            sequence = self.open[room].pop()
            self._count(room, -1)
        left = room - length
        if left:
            self.open[left].append(sequence)
            self._count(left, 1)
        return sequence, self.window - room


def cuts(tokens: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Start and length of the pieces: all of a window but the first, which may be shorter."""
    first = (tokens - 1) % window + 1
    return [(0, first), *((start, window) for start in range(first, tokens, window))]


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces of at most a window: ``doc_id, piece, start, length, ids``.

    ``tokenizer`` is the path of a vocabulary file that every worker has. A document is the ids of
    its whole text and ``end_id``; a null text counts as empty and gives ``end_id`` alone. ``ids``
    are little-endian unsigned 32-bit numbers. Rows that repeat an id are separate documents, a null
    id stays null; other columns are left out; an empty table gives no piece. Nothing is shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in in_slices(batches):
            rows: list[tuple] = []
            for name, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encode(document), end])
                for number, (start, length) in enumerate(cuts(len(ids), window)):
                    rows.append((name, number, start, length, ids[start : start + length].tobytes()))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return df.select(F.col(doc_id).cast("long"), text_or_empty(text)).mapInArrow(cut, PIECES)


def digests(found: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    rest = [c for c in found.columns if c not in ("doc_id", "piece", "start", "length", "ids")]
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *rest)


def best_fit(found: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Any rows with a ``length`` of 1 to ``window``, with ``sequence_id`` and the ``offset`` there.

    The rows are staged and numbered, and dealt by a hash of the number to groups of about
    ``group`` rows, so neither copies nor a hot source gather anywhere; a task holds the open
    sequences of one group and may pack several groups one after the other. A group leaves a
    sequence or two partly filled, which is all that packing apart costs. Rows as long as the window
    are sequences of their own and are not moved; theirs have negative numbers. The order within a
    group is by decreasing length, then by the number, so a repeated task gives the same result.

    All columns are kept, with the ids if the rows have them; columns of the caller named
    ``sequence_id`` or ``offset`` are replaced. A null length, or one out of range, fails. An empty
    table gives none.
    """
    kept = [c for c in found.columns if c not in ("sequence_id", "offset")]
    wrong = F.raise_error(F.format_string(f"length must be from 1 to {window}: %s", F.col("length").cast("string")))
    length = F.when(F.col("length").between(1, window), F.col("length")).otherwise(wrong).cast("long")
    numbered = found.select(F.monotonically_increasing_id().alias("row"), length.alias("n"), F.struct(*kept).alias("kept"))
    staged = stage(numbered, "pieces")
    short = staged.where(F.col("n") < window)
    groups = max(1, -(-short.count() // group))
    dealt = (
        short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .repartition("group")
        .sortWithinPartitions("group", F.desc("n"), "row")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, TightestFit(window)
        for batch in batches:
            sequences, offsets = [], []
            for own, n in zip(batch["group"].to_pylist(), batch["n"].to_pylist()):
                if own != group:
                    group, fit = own, TightestFit(window)
                sequence, offset = fit.place(n)
                sequences.append((own << _BIN_BITS) + sequence)
                offsets.append(offset)
            columns = [batch["kept"], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "sequence_id", "offset"])

    zero = F.lit(0).cast("long")
    alone = staged.where(F.col("n") == window).select("kept", (-F.col("row") - 1).alias("sequence_id"), zero.alias("offset"))
    return dealt.mapInArrow(place, alone.schema).unionByName(alone).select("kept.*", "sequence_id", "offset")
