"""Repeated byte strings across documents, from an enhanced suffix array over sampled positions.

Every string of WIDTH bytes has an anchor, the gram with the smallest hash inside it, so equal
strings have equal anchors. The suffixes at anchors that occur again are sorted with their common
prefixes; a scan with a stack walks the tree of common-prefix intervals from the leaves up, and the
text to the left of an interval's members splits it into maximal repeats with all occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.llm.words import mix
from litvec.runtime import stage

WIDTH = 100  # bytes of a string that counts as a repeat
GRAM = 32  # bytes of an anchor, a power of two
REACH = WIDTH - GRAM  # how far before its anchor a string may begin
SEGMENT = 1 << 20  # string starts of a document looked at together
BLOCK = 16 << 20  # bytes of text in which a task combines equal anchors before the shuffle
GROUP = 20_000  # variants of one anchor that a task holds; more go the way of single strings
_AT_BITS = 24
_POSITION = np.uint64((1 << _AT_BITS) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q, _Q_INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype="u8"))
_powers: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def _ladder(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_Q, _Q_INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(max(n, 1 << 16), base))])
    return _powers


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of WIDTH bytes: hash, place, and the first and last string start that each serves.

    Also a hash of all bytes that these strings cover. Ties go to the place further left, so what
    is chosen depends on the bytes of the string alone.
    """
    parts = []
    for a in range(0, max(0, len(data) - WIDTH + 1), SEGMENT):
        part = np.frombuffer(data, "u1", min(SEGMENT + WIDTH - 1, len(data) - a), a)
        gram, width, factor = _BYTE[part], 1, _P
        while width < GRAM:
            gram = gram[:-width] * factor + gram[width:]
            width, factor = width * 2, _squared(factor)
        gram = mix(gram)
        low = (gram & ~_POSITION) | np.arange(len(gram), dtype="u8")
        width, window = 1, REACH + 1
        while width * 2 <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if window > width:
            low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [len(low)]]) - 1
        place = (low[first] & _POSITION).astype("i8")
        up, down = _ladder(len(part) + 1)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((part + np.uint64(1)) * up[: len(part)])])
        cover = mix((sums[last + WIDTH] - sums[first]) * down[first])
        shape = ((place - first) * 128 + (place - last)).astype("u8")
        parts.append((gram[place], place + a, first + a, last + a, mix(cover ^ shape * _P)))
    if not parts:
        return np.zeros(0, "u8"), *[np.zeros(0, "i8")] * 3, np.zeros(0, "u8")
    return tuple(np.concatenate(c) for c in zip(*parts))


def _squared(factor: np.uint64) -> np.uint64:
    return np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


# A row of the first shuffle is an anchor: ``at`` holds its place and how far before it the strings
# that it serves begin. With a negative ``at`` it is bytes already known to repeat, from -at - 1 to ``cover``.
_SAMPLE = "key long, cover long, doc long, at long"
_SAMPLE_NAMES = [x.split()[0] for x in _SAMPLE.split(", ")]
# What comes out: bytes that repeat (kind 1), or a variant of an anchor (kind 2) with its strings' first and last start.
_FOUND = "kind int, key long, doc long, place long, start long, stop long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _sample_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype("i8", copy=False)) for c in columns], _SAMPLE_NAMES)


def _found_batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind, "i4"))] + [pa.array(np.asarray(c, "i8")) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, _FOUND_NAMES)


def _sampled(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's documents. Of those that serve equal bytes in a block only the first is passed on."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def combined() -> Iterator[pa.RecordBatch]:
        key, place, first, last, cover, doc = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, cover, key))
        key, place, first, last, cover, doc = (c[order] for c in (key, place, first, last, cover, doc))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (cover[1:] == cover[:-1])])
        new = ~again
        for at in np.array_split(np.flatnonzero(new), max(1, int(new.sum()) >> 16)):
            packed = place[at] << 16 | (place[at] - first[at]) << 8 | (place[at] - last[at])
            yield _sample_batch(key[at].view("i8"), cover[at].view("i8"), doc[at], packed)
        leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        other = again & ((doc != doc[leader]) | (place != place[leader]))
        start, stop, of = first[other], last[other] + WIDTH, doc[other]
        if other.any():
            order = np.lexsort((start, of))
            start, stop, of = start[order], stop[order], of[order]
            shift = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]])) << 40  # documents behind each other
            begin = np.flatnonzero(
                np.concatenate([[True], (start + shift)[1:] > np.maximum.accumulate(stop + shift)[:-1]])
            )
            ends = np.maximum.reduceat(stop, begin)
            yield _sample_batch(mix(of[begin].astype("u8")).view("i8"), ends, of[begin], -start[begin] - 1)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode()
            found = anchors(data)
            if len(found[0]):
                held.append((*found, np.full(len(found[0]), doc, "i8")))
            size += len(data)
            if size >= block and held:
                yield from combined()
                held, size = [], 0
    if held:
        yield from combined()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, cover, doc and place: bytes under anchors that repeat a cover, and variants.

    A variant is the first anchor of a cover whose key has other covers too. A task holds a batch
    and two rows before it, however often a key occurs.
    """
    key_before = cover_before = None
    leader = (0, 0)  # document and place of the last cover's first anchor
    held = None  # first row of the last key, as long as the key has one cover
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = columns[3] < 0
        if known.any():
            key, cover, doc, at = (c[known] for c in columns)
            yield _found_batch(1, key, doc, at, -at - 1, cover)
        key, cover, doc, at = (c[~known] for c in columns)
        if not len(key):
            continue
        place = at >> 16
        rows = key, doc, place, place - (at >> 8 & 255), place - (at & 255)
        new_key = np.concatenate([[key[0] != key_before], key[1:] != key[:-1]])
        new_cover = new_key | np.concatenate([[cover[0] != cover_before], cover[1:] != cover[:-1]])
        of = np.maximum.accumulate(np.where(new_cover, np.arange(len(key)), -1))
        leader_doc, leader_place = (np.where(of < 0, x, c[of]) for x, c in zip(leader, (doc, place)))
        repeats = ~new_cover & ((doc != leader_doc) | (place != leader_place))
        if repeats.any():
            yield _found_batch(1, *(c[repeats] for c in rows[:4]), rows[4][repeats] + WIDTH)
        other = new_cover & ~new_key
        of_key = np.cumsum(new_key)  # 0 is the key of the batch before
        many = np.bincount(of_key, weights=other) > 0
        firsts = np.flatnonzero(new_key)
        variants = np.concatenate([firsts[many[of_key[firsts]]], np.flatnonzero(other)])
        if len(variants):
            yield _found_batch(2, *(c[variants] for c in rows))
        if many[0] and held is not None:
            yield _found_batch(2, *([v] for v in held))
            held = None
        if len(firsts):
            held = None if many[-1] else tuple(c[firsts[-1]] for c in rows)
        key_before, cover_before, leader = key[-1], cover[-1], (leader_doc[-1], leader_place[-1])
        if new_cover[-1]:
            leader = (doc[-1], place[-1])


_CONTEXT = "key long, doc long, place long, before binary, behind binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
_SOLVED = f"{_CONTEXT}, start long, stop long"
_SOLVED_NAMES = [x.split()[0] for x in _SOLVED.split(", ")]
_CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and from each variant's anchor on, as far as its strings reach."""
    for batch in batches:
        rows = []
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            for v in wanted:
                p = v["place"]
                rows.append((v["key"], doc, p, data[v["start"] : p], data[p : v["stop"] + WIDTH]))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CONTEXT_TYPES)], _CONTEXT_NAMES)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CONTEXT_TYPES)], _CONTEXT_NAMES)


def _sorted(parts: list[bytes], width: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts as rows of bytes with their lengths, and their order within the groups."""
    joined = b"".join(p.ljust(width, b"\0") for p in parts)
    rows = np.frombuffer(joined, "u1").reshape(len(parts), width)
    keyed = np.concatenate([group.astype(">u4").view("u1").reshape(-1, 4), rows, np.ones((len(parts), 1), "u1")], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 5}").reshape(-1), kind="stable")
    return rows, np.array([len(p) for p in parts]), order


def _common(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = rows[a] != rows[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(lengths[a], lengths[b]))


def repeats_of(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, befores: list[bytes], behinds: list[bytes]) -> Iterator[tuple]:
    """Maximal repeats of suffixes that begin at equal anchors.

    ``keys`` names the anchors; the suffixes of a key stand together. Yields the members of each
    repeat group, first occurrence first, with the smallest and largest number of bytes before the
    anchor at which a string of WIDTH bytes begins that all of them share.
    """
    n = len(keys)
    rank = np.empty(n, "i8")
    rank[np.lexsort((places, docs))] = np.arange(n)
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    right, right_length, suffixes = _sorted(behinds, WIDTH, group)
    left, left_length, prefixes = _sorted([b[::-1] for b in befores], REACH, group)
    height = _common(right, right_length, suffixes[:-1], suffixes[1:])
    height[group[suffixes[1:]] != group[suffixes[:-1]]] = -1
    apart = _common(left, left_length, prefixes[:-1], prefixes[1:])
    apart[group[prefixes[1:]] != group[prefixes[:-1]]] = -1
    beside = _common(left, left_length, suffixes[:-1], suffixes[1:])
    left_rank = np.empty(n, "i8")
    left_rank[prefixes] = np.arange(n)

    # Intervals of the suffix array whose members share `depth` bytes, children before their parent.
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*height.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > depth:
            top, begin = stack.pop()
            above = max(depth, stack[-1][0] if stack else -1)
            low, high = max(WIDTH - top, 0), min(WIDTH - 1 - above, REACH)
            if low > high or top < GRAM:
                continue
            if i == begin + 1:  # two suffixes: what they share to the left is known
                a, b = int(suffixes[begin]), int(suffixes[i])
                reach = min(high, int(beside[begin]))
                if reach >= low:
                    yield ([a, b] if rank[a] < rank[b] else [b, a]), low, reach
                continue
            members = suffixes[begin : i + 1]
            members = members[np.argsort(left_rank[members])]
            at = left_rank[members]
            shared = np.minimum.reduceat(apart[at[0] : at[-1]], at[:-1] - at[0])
            # Left diversity: up to the smallest shared length the members are one repeat, beyond they part.
            steps = sorted({int(s) for s in shared if low <= s < high} | {high})
            for reach in steps:
                borders = np.flatnonzero(shared < reach) + 1
                for part in np.split(members, borders):
                    if len(part) > 1:
                        yield part[np.argsort(rank[part])].tolist(), low, reach
                low = reach + 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def _tree(batches: Iterator[pa.RecordBatch], group: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Bytes of occurrences that are not the first of their repeat, from contexts sorted by key.

    Keys with more variants than ``group`` are passed on as they are, without start and stop.
    """
    rows: list[tuple] = []
    large = None  # the key being passed on

    def solved(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, befores, behinds = zip(*part)
        keys, docs, places = np.array(keys), np.array(docs), np.array(places)
        starts, stops, of = [], [], []
        for members, low, reach in repeats_of(keys, docs, places, list(befores), list(behinds)):
            first = members[0]
            for m in members[1:]:
                if docs[m] != docs[first] or places[m] != places[first]:
                    of.append(m)
                    starts.append(places[m] - reach)
                    stops.append(places[m] - low + WIDTH)
        if of:
            none = pa.nulls(len(of), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[of]), pa.array(docs[of]), pa.array(places[of]), none, none, pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
                _SOLVED_NAMES,
            )

    def passed(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        if part:
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*part), _CONTEXT_TYPES)), none, none], _SOLVED_NAMES)

    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns))
        if large is not None:
            still = next((i for i, r in enumerate(rows) if r[0] != large), len(rows))
            yield from passed(rows[:still])
            rows = rows[still:]
            if not rows:
                continue
            large = None
        key = rows[-1][0]
        tail = next((i + 1 for i in range(len(rows) - 1, -1, -1) if rows[i][0] != key), 0)
        whole, rows = rows[:tail], rows[tail:]
        yield from _by_size(whole, group, solved, passed)
        if len(rows) > group:
            large = key
            yield from passed(rows)
            rows = []
    yield from _by_size(rows, group, solved, passed)


def _by_size(rows: list[tuple], group: int, solved, passed) -> Iterator[pa.RecordBatch]:
    """Rows of whole keys: those of large keys passed on, the others solved some thousand at a time."""
    a, ready = 0, []
    while a < len(rows):
        b = a
        while b < len(rows) and rows[b][0] == rows[a][0]:
            b += 1
        if b - a > group:
            yield from passed(rows[a:b])
        else:
            ready += rows[a:b]
        if len(ready) >= GROUP:
            yield from solved(ready)
            ready = []
        a = b
    if ready:
        yield from solved(ready)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every string of WIDTH bytes of a variant: 128 bits of its hash, document and start."""
    for batch in batches:
        out: list[tuple] = []
        for doc, place, before, behind in zip(*(c.to_pylist() for c in batch.columns)):
            data, start = before + behind, place - len(before)
            for i in range(len(data) - WIDTH + 1):
                digest = hashlib.blake2b(data[i : i + WIDTH], digest_size=16).digest()
                out.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), doc, start + i))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["h1", "h2", "doc", "start"])


def _large_groups(contexts: DataFrame) -> DataFrame:
    """Bytes of later occurrences among variants of anchors too frequent for one task: ``doc, start, stop``.

    Their strings are grouped by hash, combined in map tasks first, and met again by a join.
    """
    strings = stage(
        contexts.select("doc", "place", "before", "behind").mapInArrow(_strings, "h1 long, h2 long, doc long, start long"),
        "strings",
    )
    firsts = (
        strings.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        .agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("g1", "g2", "first")
    )
    return (
        strings.join(stage(firsts, "firsts"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
        .where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
        .select("doc", "start", (F.col("start") + WIDTH).alias("stop"))
    )


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def repeated_spans(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """``doc`` and ``spans`` (start, stop in bytes, possibly overlapping) of all later occurrences.

    A byte is covered if a string of 100 bytes around it starts earlier too: in a document with a
    smaller id, or in the same one. Rows with a null id take no part.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text")).where("doc is not null")
    sampled = own.mapInArrow(lambda batches: _sampled(batches, block), _SAMPLE).repartition("key").sortWithinPartitions("key", "cover", "doc", "at")
    found = stage(sampled.mapInArrow(_again, _FOUND), "anchors")
    wanted = (
        found.where("kind = 2")
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_list(F.struct("key", "place", "start", "stop")).alias("wanted"))
    )
    contexts = own.join(wanted, F.col("doc") == F.col("of")).select("doc", "text", "wanted")
    by_key = contexts.mapInArrow(_contexts, _CONTEXT).repartition("key").sortWithinPartitions("key")
    tree = stage(by_key.mapInArrow(lambda batches: _tree(batches, group), _SOLVED), "repeats")
    spans = (
        found.where("kind = 1")
        .select("doc", "start", "stop")
        .union(tree.where("start is not null").select("doc", "start", "stop"))
        .union(_large_groups(tree.where("start is null")))
    )
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """A row per row of ``df``: ``doc_id, n_bytes, spans`` (merged, in bytes) and ``kept`` (the remaining bytes).

    The first occurrence of every string of 100 bytes stays, by document id and place; bytes of
    later ones go. Strings are judged on the input, overlaps count, matches do not cross
    documents. A null text counts as empty; a row with a null id keeps all its bytes and is compared
    with none. Rows that repeat an id are one document and have to repeat its text. An empty table
    gives an empty one.

    Equal anchors are combined in every map task before they are shuffled; sorted rows stream
    through the tasks, so a passage that a third of all documents share is held by none. What is
    left of the kept bytes need not be valid UTF-8, so it is binary.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    spans = stage(repeated_spans(df, doc_id, text, block, group), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, found in zip(*(c.to_pylist() for c in batch.columns)):
                data, at, kept = body.encode(), 0, []
                merged = _merged(found or [])
                for start, stop in merged:
                    kept.append(data[at:start])
                    at = stop
                rows.append((doc, len(data), [{"start": a, "stop": b} for a, b in merged], b"".join([*kept, data[at:]])))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    return (
        own.join(spans, F.col("doc_id") == F.col("doc"), "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    )


def digests(removed: DataFrame) -> DataFrame:
    """Counts and the digest of the kept bytes."""
    bytes_in = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return removed.select(
        "doc_id",
        "n_bytes",
        bytes_in.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
