"""Documents as token ids, packed into sequences of one window without padding between them.

Lengths are counted in classes. Combinations of at most three classes that fill the window are
enumerated, their repeat counts are the non-negative least-squares fit to the counts, rounded to
what is there; what is left over is packed greedily, cut where a window is full.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.llm.words import in_slices

WINDOW = 2048
END_ID = 1
STEP = 16  # tokens per length class
BLOCK_TOKENS = 4_000_000  # packed together by a task, 16 MB of ids
_WORDS_KEPT = 1_000_000
_LONGEST_WORD = 64
_ROW_BITS = 33


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of texts, encoded word by word so that repeated words are encoded once.

    A vocabulary that never joins characters across white space gives the same ids for the words
    as for the whole text. Words are kept up to a fixed number, then forgotten. Words of plain
    Latin letters are one unit of the vocabulary's pattern and go straight to its model, if a
    trial shows that the model then gives what the whole tokenizer gives.
    """

    _TRIAL = ("the", "Zebra", "über", "éÀÿ", "ñandú", "straße", "a", "QUICKEST", "ªº")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.plain = [self._model(w) for w in self._TRIAL] == self._encode(list(self._TRIAL))

    def _model(self, word: str) -> bytes:
        lower = word.lower()
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(lower)]).tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > _WORDS_KEPT:
            self.known = {"": b""}
        # A word and the full stop or comma behind it are encoded apart, as the vocabulary splits them anyway. Other
        # letters than these may become a letter and a mark, which is one unit with the mark behind it.
        stems = {w: w[:-1] for w in words if len(w) > 1 and w[-1] in ".," and w[-2].isalpha() and w[-2] < "\u0130"}
        parts = {stems.get(w, w) for w in words}.union(w[-1] for w in stems)
        fresh = [w for w in parts if w not in self.known]
        if self.plain:
            latin = [w for w in fresh if w.isalpha() and (w.isascii() or max(w) < "\u0130")]
            self.known.update((w, self._model(w)) for w in latin)
            fresh = [w for w in fresh if w not in self.known]
        self.known.update(zip(fresh, self._encode(fresh)))
        for word, stem in stems.items():
            self.known[word] = self.known[stem] + self.known[word[-1]]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        unknown = {w for words in split for w in words if w not in self.known}
        long = {w for w in unknown if len(w) > _LONGEST_WORD}
        unknown -= long
        if len(unknown) > _WORDS_KEPT // 4:
            return [np.frombuffer(x, "<u4") for x in self._encode(texts)]
        if unknown:
            self._learn(unknown)
        out = []
        for text, words in zip(texts, split):
            try:
                ids = b"".join([self.known[w] for w in words])
            except KeyError:  # a long word, or older words were forgotten meanwhile
                ids = self._encode([text])[0]
            out.append(np.frombuffer(ids, "<u4"))
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def fillings(classes: int) -> np.ndarray:
    """Columns: how often each of the classes 1..n occurs in a combination of up to three that sums to n."""
    columns = [(classes,)]
    columns += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    columns += [
        (a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)
    ]
    out = np.zeros((classes, len(columns)), "f8")
    for j, column in enumerate(columns):
        for c in column:
            out[c - 1, j] += 1
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets after Lawson and Hanson, on the normal equations."""
    square, right = a.T @ a, a.T @ b
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = right - square @ x
        gain[inside] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        inside[j] = True
        while inside.any():
            at = np.flatnonzero(inside)
            # A trace on the diagonal keeps dependent columns solvable; counts are rounded afterwards anyway.
            best = np.linalg.solve(square[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), right[at])
            here, low = x[at], best <= 1e-9
            if not low.any():
                x[at] = best
                break
            ratio = here[low] / np.maximum(here[low] - best[low], 1e-300)
            here = here + min(1.0, float(ratio.min())) * (best - here)
            here[(here <= 1e-9) | (low & (here <= 1e-6))] = 0
            x[:] = 0
            x[at] = here
            inside = x > 0
    return x


def _powers(tokens: int) -> list[int]:
    return [1 << i for i in range(tokens.bit_length() - 1, -1, -1) if tokens >> i & 1]


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, step: int = STEP) -> dict[str, np.ndarray]:
    """Pieces of documents with these numbers of tokens: ``doc, start, length, sequence, offset``.

    A document longer than the window fills windows of its own first. A class holds the lengths
    up to its multiple of ``step``, so a combination never overfills the window. Only documents
    left over by the fit are cut, where their window is full; the tokens that fill no last window
    go into sequences of decreasing powers of two, which need no padding.
    """
    lengths = np.asarray(lengths, "i8")
    whole, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), whole)
    n_full = len(doc)
    before = np.concatenate([[0], np.cumsum(whole)[:-1]]) if len(lengths) else np.zeros(0, "i8")
    parts = [(doc, (np.arange(n_full) - before[doc]) * window, np.full(n_full, window), np.arange(n_full), np.zeros(n_full, "i8"))]
    sequence = n_full
    classes = window // step  # lengths beyond the last class are left over
    kinds = -(-rest // step)
    queues = [np.flatnonzero(kinds == c + 1) for c in range(classes)]
    left = np.array([len(q) for q in queues])
    taken = np.zeros(classes, "i8")
    if left.sum():
        columns = fillings(classes)
        counts = non_negative_least_squares(columns, left.astype("f8"))
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] < 0.5:
                break
            need = columns[:, j].astype("i8")
            at = np.flatnonzero(need)
            n = min(round(counts[j]), int(((left - taken)[at] // need[at]).min()))
            if n <= 0:
                continue
            offset = np.zeros(n, "i8")
            for c in at:
                for _ in range(need[c]):
                    picked = queues[c][taken[c] : taken[c] + n]
                    taken[c] += n
                    parts.append((picked, whole[picked] * window, rest[picked], sequence + np.arange(n), offset))
                    offset = offset + rest[picked]
            sequence += n
    over = np.concatenate([np.flatnonzero(kinds > classes), *[q[t:] for q, t in zip(queues, taken)][::-1]])
    total = int(rest[over].sum())
    ends = [*range(window, total + 1, window)]
    for size in _powers(total % window):
        ends.append((ends[-1] if ends else 0) + size)
    if total:
        stops = np.cumsum(rest[over])
        cuts = np.unique(np.concatenate([stops, ends]))
        starts = np.concatenate([[0], cuts[:-1]])
        of = np.searchsorted(stops, starts, side="right")
        into = np.searchsorted(ends, starts, side="right")
        begins = np.concatenate([[0], ends])
        parts.append(
            (
                over[of],
                whole[over[of]] * window + starts - (stops - rest[over])[of],
                cuts - starts,
                sequence + into,
                starts - begins[into],
            )
        )
    return {k: np.concatenate([p[i] for p in parts]).astype("i8") for i, k in enumerate(("doc", "start", "length", "sequence", "offset"))}


OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``tokenizer`` is the path of a vocabulary that every worker has; it must not join characters
    across white space. A document is its ids and the id 1; a null text counts as empty and gives
    the id 1 alone. ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. Rows that
    repeat an id are separate documents, a null id stays null; an empty table gives no piece.

    Nothing is shuffled: a task packs its documents in blocks of bounded size, so memory does not
    grow with the table, and copies or a hot length fill more blocks, not a larger one. Sequence
    numbers hold the partition in their upper bits; a repeated task gives the same ones.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        first = TaskContext.get().partitionId() << _ROW_BITS
        names: list = []
        held: list[np.ndarray] = []
        tokens = 0
        end = np.array([END_ID], "<u4")

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, names, held, tokens
            lengths = np.array([len(x) for x in held])
            pieces = pack_lengths(lengths, window)
            for a in range(0, len(pieces["doc"]), 4096):
                part = {k: v[a : a + 4096] for k, v in pieces.items()}
                ids = [held[d][s : s + n].tobytes() for d, s, n in zip(part["doc"], part["start"], part["length"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in part["doc"]], pa.int64()),
                        pa.array(part["start"]),
                        pa.array(part["length"]),
                        pa.array(lengths[part["doc"]], pa.int64()),
                        pa.array(part["sequence"] + first),
                        pa.array(part["offset"]),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            first += int(pieces["sequence"].max(initial=-1)) + 1
            names, held, tokens = [], [], 0

        for batch in in_slices(batches):
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                names.append(name)
                held.append(np.concatenate([ids, end]))
                tokens += len(held[-1])
                if tokens >= block_tokens:
                    yield from packed()
        if held:
            yield from packed()

    return df.select(F.col(doc_id).cast("long"), text_or_empty(text)).mapInArrow(blocks, OUT)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
