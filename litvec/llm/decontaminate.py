"""Passages of benchmark items in documents, by SimHash fingerprints of item-sized windows.

Windows with as many words as an item are fingerprinted where a document shares a shingle with
some item; elsewhere no window can be similar. Fingerprints have several blocks, each with a radius of
its own: whatever is within the radius of the whole is within that of a block, and few other items are.
What is within the radius is verified by the weighted similarity of shingles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.llm.words import SHINGLE, in_slices, mix, shingles, word_hashes
from litvec.runtime import small_side, stage

SIMILARITY = 0.8
BITS, BLOCKS = 256, 4
# Fingerprints of texts of similarity 0.8 differ in 39 of 256 bits on average, in 48 if they have five shingles and four of
# these; in more than 80 less than once in a million.
RADIUS = 80
# Radius of each block: if all blocks differ in more, the whole differs in more than RADIUS.
NEAR = np.array([(RADIUS - BLOCKS + 1) // BLOCKS + (i < (RADIUS - BLOCKS + 1) % BLOCKS) for i in range(BLOCKS)], "u1")
# Items that one pass over the documents carries; more are searched in further passes.
PASS_ITEMS, PASS_BYTES = 20_000, 2 << 20
_MAP_BITS = 22


def fingerprints(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """SimHash of runs of shingles, each shingle weighted by its count: a row of ``BLOCKS`` 64-bit numbers for each run."""
    wide = mix(x[:, None] + np.arange(BLOCKS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(wide.view("u1").reshape(len(x), -1), axis=1).astype("i4") * 2 - 1
    off = np.cumsum(many) - many
    signs = np.add.reduceat(bits, off, axis=0) > 0
    return np.packbits(signs, axis=1).view("u8")


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over all weight."""
    shared = sum((a & b).values())
    return shared / max(1, a.total() + b.total() - shared)


class Items:
    """Index of the items of one pass."""

    def __init__(self, names: list[int], texts: list[str]):
        words, counts = word_hashes(texts)
        x, many = shingles(words, counts)
        full = np.flatnonzero(counts)
        self.names = [names[k] for k in full]
        self.size = counts[full]
        stops = np.cumsum(many)[full]
        self.weights = [Counter(x[e - n : e].tolist()) for e, n in zip(stops, many[full])]
        self.prints = fingerprints(x, many[full]) if len(full) else np.zeros((0, BLOCKS), "u8")
        # Where each shingle lies in which items; short items have one shingle of all their words.
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (e, n) in enumerate(zip(stops, many[full])):
            for q, s in enumerate(x[e - n : e].tolist()):
                self.places[s].append((k, q))
        self.grams = sorted({min(SHINGLE, int(n)) for n in self.size})
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[x >> np.uint64(64 - _MAP_BITS)] = True
        self.of_size = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size)}
        self.columns = {n: np.ascontiguousarray(self.prints[k].T) for n, k in self.of_size.items()}

    def candidates(self, size: int, fingerprint: np.ndarray) -> np.ndarray:
        """Items of that size that are within the radius of some block.

        At this similarity no run of equal bits is selective, so a block is not looked up but compared with the
        blocks of all items of the size in one array operation.
        """
        if size not in self.of_size:
            return np.zeros(0, "i8")
        hit = np.zeros(len(self.of_size[size]), bool)
        for column, block, most in zip(self.columns[size], fingerprint, NEAR):
            hit |= np.bitwise_count(column ^ block) <= most
        return self.of_size[size][hit]

    def within_radius(self, size: int, fingerprint: np.ndarray) -> list[int]:
        near = self.candidates(size, fingerprint)
        return near[np.bitwise_count(self.prints[near] ^ fingerprint).sum(axis=1) <= RADIUS].tolist()

    def windows(self, words: np.ndarray, shorter: bool = False) -> set[tuple[int, int]]:
        """Start and size of the windows of a document that share a shingle with an item of that size.

        With ``shorter``, the whole document is the window of an item with more words, if it has
        enough shingles for the similarity.
        """
        lines: dict[int, set[int]] = defaultdict(set)
        for gram in self.grams:
            x, _ = shingles(words, np.array([len(words)]), gram)
            for p in np.flatnonzero(self.map[x >> np.uint64(64 - _MAP_BITS)]).tolist():
                for k, q in self.places.get(int(x[p]), ()):
                    size = int(self.size[k])
                    if min(SHINGLE, size) != gram:
                        continue
                    if len(words) >= size:
                        lines[k].add(min(max(p - q, 0), len(words) - size))
                    elif shorter and len(x) >= SIMILARITY * (size - gram + 1):
                        lines[k].add(0)
        out = set()
        for k, starts in lines.items():
            size, last = int(self.size[k]), None
            for s in sorted(starts):  # and, where words were left out or added, the starts in between
                out.update((t, size) for t in range(s if last is None or s - last > size // 4 else last, s + 1))
                last = s
        return out

    def find(self, words: np.ndarray, shorter: bool = False) -> list[tuple[int, int, float]]:
        """Item, first word and similarity of the best window of each item that the document holds."""
        best: dict[int, tuple[float, int]] = {}
        for start, size in sorted(self.windows(words, shorter)):
            window = words[start : start + size]
            x, many = shingles(window, np.array([len(window)]))
            own = Counter(x.tolist())
            for k in self.within_radius(size, fingerprints(x, many)[0]):
                similarity = weighted_similarity(own, self.weights[k])
                if similarity >= SIMILARITY and similarity > best.get(k, (0.0, 0))[0]:
                    best[k] = similarity, start
        return [(self.names[k], start, similarity) for k, (similarity, start) in sorted(best.items())]


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[Items, bool]]:
    """Items in passes of about so many rows and bytes, and whether there are several; the driver holds one pass at a time."""
    own = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("body"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.length("body")), F.lit(0))).first()
    passes = max(-(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    if passes > 1:
        own = stage(own.withColumn("row", F.monotonically_increasing_id()), "items")
    for p in range(passes):
        rows = own.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p) if passes > 1 else own
        rows = rows.select("id", "body").collect()
        if rows:
            yield Items([r.id for r in rows], [r.body for r in rows]), passes > 1


def _per_slice(items: Items, batches: Iterator[pa.RecordBatch], shorter: bool):
    for batch in in_slices(batches):
        words, counts = word_hashes(batch.column(1).to_pylist())
        # One look at all shingles of the slice tells which texts share any with an item.
        hit = np.zeros(batch.num_rows, bool)
        for gram in items.grams:
            x, many = shingles(words, counts, gram)
            at = np.flatnonzero(items.map[x >> np.uint64(64 - _MAP_BITS)])
            hit[np.unique(np.searchsorted(np.cumsum(many), at, side="right"))] = True
        ends = np.cumsum(counts)
        yield batch, {int(r): items.find(words[ends[r] - counts[r] : ends[r]], shorter) for r in np.flatnonzero(hit)}


def contamination(
    df: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shorter: bool = False,
) -> DataFrame:
    """A row for each document and item that it holds: ``doc_id, item_id, start_word, similarity``.

    Of the windows with the item's number of words the most similar one counts, then the first;
    it has to reach 0.8 in weighted five-word shingles (one of all words for shorter items). With
    ``shorter``, a document of fewer words than the item is compared as a whole. A
    null text or item, or one without a word, matches nothing; a null id stays null; rows that
    repeat are found again each, and empty tables give no row. Nothing is shuffled, and a passage
    that many documents share costs each of them the same.
    """
    own = df.select(F.col(doc_id).cast("long"), text_or_empty(text))
    schema = "doc_id long, item_id long, start_word long, similarity double"
    out = df.sparkSession.createDataFrame([], schema)
    for known, several in _passes(items, item_id, item_text):

        def found(batches: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            for batch, hits in _per_slice(known, batches, shorter):
                names = batch.column(0).to_pylist()
                rows = [(names[r], *hit) for r, matches in hits.items() for hit in matches]
                columns = list(zip(*rows)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start_word", "similarity"]
                )

        hits = own.mapInArrow(found, schema)
        out = out.union(stage(hits, "hits") if several else hits)
    return out


def drop_contaminated(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``df``, with all their columns, that hold no item and are no shortened one.

    Items of one pass are searched while rows pass. With more, the digests of the texts that hold one are
    staged pass by pass, and rows are dropped by a counted and weighed list of them.
    """
    own = df.columns
    at = own.index(text)
    digest = F.sha2(text_or_empty(text), 256)
    listed = []
    for known, several in _passes(items, item_id, item_text):

        def kept(batches: Iterator[pa.RecordBatch], at: int = at, hold: bool = False, known: Items = known):
            for batch in batches:
                a = 0
                pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at).fill_null("")], ["id", "text"])
                for part, hits in _per_slice(known, iter([pair]), True):
                    keep = [bool(hits.get(r)) == hold for r in range(part.num_rows)]
                    yield batch.slice(a, part.num_rows).filter(pa.array(keep, pa.bool_()))
                    a += part.num_rows

        if not several:
            return df.mapInArrow(kept, df.schema)
        texts = df.select(digest.alias("digest"), text_or_empty(text).alias("body"))
        holding = texts.mapInArrow(partial(kept, at=1, hold=True), texts.schema)
        listed.append(stage(holding.select("digest").distinct(), "held"))
    if not listed:
        return df
    held = reduce(DataFrame.union, listed).distinct()
    rows = df.select(F.struct("*").alias("own"), digest.alias("digest"))
    left = rows.join(small_side(held, "held"), "digest", "left_anti")
    return left.select(*[F.col("own").getField(c).alias(c) for c in own])
