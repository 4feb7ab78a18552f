"""Words of many texts as 64-bit hashes, five-word shingles of them: numpy inside Arrow tasks.

A word is a run of letters and digits in lower case; every character beyond ASCII counts as a letter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[np.uint64, np.ndarray] = {}
# Only the C library of Linux has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash; a bijection."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(max(n, 1 << 16), base))])
    return _powers[base]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. Works in pieces of about a megabyte."""
    encoded = [t.lower().encode() for t in texts]
    data = b"".join(e + b"\n" for e in encoded)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    hashes, starts_of = [], []
    a = 0
    while a < len(data):
        b = data.find(b" ", a + _PIECE)
        b = len(data) if b < 0 else b + 1
        part = np.frombuffer(data, "u1", b - a, a)
        letter = np.concatenate([[False], _LETTER[part], [False]])
        turns = np.flatnonzero(letter[1:] != letter[:-1])
        starts, stops = turns[::2], turns[1::2]
        sums = np.zeros(len(part) + 1, "u8")
        np.cumsum((part + np.uint64(1)) * _power(_P, len(part))[: len(part)], out=sums[1:])
        hashes.append(mix((sums[stops] - sums[starts]) * _power(_P_INVERSE, len(part))[starts]))
        starts_of.append(starts + a)
        a = b
    words = np.concatenate(hashes) if hashes else np.zeros(0, "u8")
    starts = np.concatenate(starts_of) if starts_of else np.zeros(0, "i8")
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return words, counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row and their number for each text; a shorter text has one of all its words."""
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, many)
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    end = np.repeat(np.cumsum(counts), many)
    out = np.zeros(len(at), "u8")
    for t in range(size):
        inside = at + t < end
        word = words[np.where(inside, at + t, 0)] if len(words) else out
        out = np.where(inside, out * _P + word, out)
    return mix(out), many


def by_occurrence(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence within their text: the first, the second and so on."""
    text = np.repeat(np.arange(len(many)), many)
    key = x ^ mix(text.astype("u8") + np.uint64(1))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return x
    at = np.flatnonzero(np.isin(key, again))
    at = at[np.argsort(key[at], kind="stable")]
    new = np.concatenate([[True], key[at][1:] != key[at][:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = x.copy()
    occurrence = (np.arange(len(at)) - begin).astype("u8")
    out[at] = np.where(occurrence > 0, mix(x[at] + occurrence * _P), x[at])
    return out


def in_slices(batches: Iterator, size: int = 1 << 21) -> Iterator:
    """Batches cut into slices of a bounded number of text bytes (one row at least); the text is column 1.

    At the end the memory of past batches goes back to the system, as workers live on into later stages.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("i8")
        slot = np.cumsum(lengths) // size
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(slot, slot[a], side="right"))
            yield batch.slice(a, b - a)
            a = b
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
