"""Near duplicates by Order MinHash.

A text is its five-word shingles, told apart by occurrence. For each of several hash functions
the two smallest are kept in the order of the text, so a sketch agrees only if the shingles and
their order do. Texts that share a sketch are compared by banded alignment of all their shingles.
Where too many share one, pairs that are not connected yet are found by their rarest shingles.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import components, text_or_empty, without
from litvec.llm.words import by_occurrence, in_slices, mix, shingles, word_hashes
from litvec.runtime import small_side, stage

SIMILARITY = 0.8
# Two texts of similarity 0.8 agree in one sketch with probability about 0.64, in none of 12 with 5e-6.
SKETCHES = 12
# Buckets up to this size are paired in full, larger ones by hubs and random leaders.
SMALL = 8
HUBS, LEADERS = 3, 16
# Members meet leaders that agree with them in this many sketches, as 99.4 % of pairs of similarity 0.8 do, and
# in each round this many random ones, those that agree in most. The rest is left to rare shingles.
AGREEMENT, NEAREST, MEETINGS = 4, 3, 16
# A further round is worth its passes over all members if the last one joined this share of their classes.
GAIN = 0.1
# Counters for the order of shingles by rarity, and the members of a rare shingle that one row holds.
_COUNTER_BITS, BLOCK = 18, 400
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def order_sketches(x: np.ndarray, many: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """A row of sketches for each text with a shingle. ``x`` holds the texts' shingles, ``many`` their numbers (all > 0)."""
    off = np.cumsum(many) - many
    several = many > 1
    out = np.empty((len(many), sketches), "u8")
    for j in range(sketches):
        g = (x ^ _SEEDS[2 * j]) * (_SEEDS[2 * j + 1] | np.uint64(1))
        g ^= g >> np.uint64(32)
        at = []
        for _ in range(2):
            hit = np.flatnonzero(g == np.repeat(np.minimum.reduceat(g, off), many))
            at.append(hit[np.searchsorted(hit, off)])
            g[at[-1]] = _LAST
        low, high = x[np.minimum(*at)], x[np.maximum(*at)]
        out[:, j] = np.where(several, mix(low * np.uint64(3) + high), mix(x[at[0]]))
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> float:
    """Shingles that agree in order over all shingles; 0 if it cannot reach ``at_least``.

    ``a`` and ``b`` hold labelled shingles, each once. Equal ones are matched within a band as
    wide as the similarity allows; the longest chain that ascends in both texts is the alignment.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    need = at_least * (len(a) + len(b)) / (1 + at_least)
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    band = max(len(a), len(b)) - int(np.ceil(need)) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) + 1e-9 < need:
        return 0.0
    j = j[np.argsort(i, kind="stable")]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for position in j.tolist():
            k = bisect_left(tails, position)
            tails[k : k + 1] = [position]
        chain = len(tails)
    return chain / (len(a) + len(b) - chain)


def _labelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, counts = word_hashes(texts)
    x, many = shingles(words, counts)
    return words, counts, by_occurrence(x, many), many


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        texts = batch.column(1).to_pylist()
        words, counts, x, many = _labelled(texts)
        ends = np.cumsum(counts)
        digests = [
            blake2b(words[e - n : e].tobytes() if n else b"-" + t.encode(), digest_size=16).hexdigest()
            for t, n, e in zip(texts, counts, ends)
        ]
        full = np.flatnonzero(many)
        rows: list[list[int]] = [[] for _ in texts]
        if len(full):
            for k, row in zip(full, order_sketches(x, many[full]).view("i8").tolist()):
                rows[k] = row
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(digests), pa.array(many.astype("i4")), pa.array(rows, pa.list_(pa.int64()))],
            ["doc_id", "mark", "digest", "shingles", "sketches"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        left, right = (_labelled(batch.column(c).to_pylist()) for c in (1, 3))
        la, lb = np.cumsum(left[3]), np.cumsum(right[3])
        found = [
            aligned_similarity(left[2][p - m : p], right[2][q - n : q]) for p, m, q, n in zip(la, left[3], lb, right[3])
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["a", "b", "similarity"]
        )


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: ``doc_id``, ``class_id`` (the smallest id of its class) and ``copy_of``.

    Texts with the same words in the same order are copies of the one with the smallest id; texts
    without any word are copies if they are equal, so null and empty texts are. Different texts
    are linked at a similarity of 0.8 or more of their five-word shingles, aligned in order, and
    classes are what links connect. Texts are told apart by a row number that is staged with their
    sketches, so an id may repeat and stand for several texts. A row with a null id has a null class
    and stands for itself; an empty table gives an empty one.

    Copies leave the search as one text. Buckets of a few texts that share a sketch are paired in
    full. A larger bucket is neither gathered nor paired: its members meet its hubs, those that share
    most sketches with others, found by an aggregate. Members that stay out of the main hub's class
    then meet random members of that class and of the rest that agree with them in most sketches, in
    rounds that go on while one joins a tenth of the classes left, so their number grows with the
    logarithm of the texts at most. These rounds only save work: members of a bucket that are of
    different classes at the end are compared by ``_rare_pairs``, which leaves out no pair that can
    reach 0.8, however few sketches it shares. So a pair that shares a sketch is linked in large
    buckets as it is in small ones.
    """
    return _judged(df, doc_id, text).select("doc_id", "class_id", "copy_of")


def _judged(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with ``mark``, a hash of the text, and ``kept``: the one row of its class that stays."""
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))
    sketched = own.mapInArrow(_sketch, "doc_id long, mark long, digest string, shingles int, sketches array<long>")
    sketched = stage(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # From here on the id of a text is the number of its first row, and its name the id of that row.
    texts = stage(
        sketched.where("doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "row", "mark")).alias("first"),
            F.first("shingles").alias("shingles"),
            F.first("sketches").alias("sketches"),
        )
        .select("digest", "first.doc_id", F.col("first.row").alias("id"), "first.mark", "shingles", "sketches"),
        "texts",
    )
    every = texts.select("id", "shingles", F.posexplode("sketches").alias("j", "sketch")).select(
        F.xxhash64("j", "sketch").alias("bucket"), "id", "shingles"
    )
    shared = small_side(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = stage(every.join(shared, "bucket"), "members")
    crowded = members.where(F.col("n") > SMALL).groupBy("id")
    crowded = crowded.agg(F.sum("n").alias("degree"), F.collect_list("bucket").alias("buckets"))
    large = stage(texts.drop("digest", "doc_id", "mark").join(small_side(crowded, "crowded"), "id"), "large")
    pairs = _paired(members.where(F.col("n") <= SMALL)).union(_with_hubs(large)).distinct()
    pairs = small_side(pairs, "pairs")
    bodies = _bodies(own, texts, pairs, large)
    alone = bodies.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class_id"))
    classes, _ = _merged(small_side(alone, "classes"), _linked(pairs, bodies))
    apart = large.join(classes, "id").select("class_id").distinct().count()
    met, turn, worthwhile = pairs, 1, apart > 0
    while worthwhile:
        fresh = _random_pairs(large, classes, turn).distinct().join(met, ["a", "b"], "left_anti")
        pairs = small_side(fresh, "pairs")
        met = met.union(pairs)
        links = _linked(pairs, bodies)
        if links.isEmpty():
            break
        classes, joined = _merged(classes, links)
        worthwhile = joined >= GAIN * apart
        apart, turn = apart - joined, turn + 1
    rest = _rare_pairs(large, bodies, classes).distinct().join(met, ["a", "b"], "left_anti")
    links = _linked(small_side(rest, "rest"), bodies)
    if not links.isEmpty():
        classes, _ = _merged(classes, links)

    named = texts.select("digest", "id", "doc_id").join(classes, "id", "left")
    named = stage(named.withColumn("class", F.coalesce("class_id", "id")).drop("class_id"), "named")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "id")).alias("stays"), F.count("*").alias("n")).where("n > 1")
    several = named.join(small_side(first, "classes-first"), "class", "left")
    copies = several.select(
        "digest",
        F.col("doc_id").alias("copy_of"),
        F.coalesce("stays.doc_id", "doc_id").alias("class_id"),
        F.coalesce("stays.id", "id").alias("stays"),
    )
    has_id = F.col("doc_id").isNotNull()
    return sketched.join(stage(copies, "copies"), "digest", "left").select(
        "doc_id",
        "mark",
        F.when(has_id, F.col("class_id")).alias("class_id"),
        F.when(has_id, F.col("copy_of")).alias("copy_of"),
        (~has_id | (F.col("row") == F.col("stays"))).alias("kept"),
    )


def _similar_size(a: Column | str, b: Column | str) -> Column:
    """Whether two numbers of shingles allow the similarity at all."""
    return F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b)


def _agreement(a: Column, b: Column) -> Column:
    """Number of sketches in which two texts agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal))


def _paired(members: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of small buckets."""
    lists = members.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "shingles"))).alias("m"))

    def behind(x: Column, i: Column) -> Column:
        partners = F.filter(F.slice("m", i + 2, F.size("m")), lambda y: _similar_size(x["shingles"], y["shingles"]))
        return F.transform(partners, lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))

    return lists.select(F.explode(F.flatten(F.transform("m", behind))).alias("p")).select("p.a", "p.b")


def _by_bucket(large: DataFrame) -> DataFrame:
    """A row for each large bucket of a text; ``large`` has a row per text."""
    return large.select("*", F.explode("buckets").alias("bucket")).drop("buckets")


def _hubs(members: DataFrame) -> DataFrame:
    """Of each large bucket the members that share most sketches with others, and the one with the smallest id."""
    fields = ("id", "shingles", "sketches")
    most = [F.max(F.struct("degree", F.xxhash64(F.lit(-i), "id").alias("h"), *fields)) for i in range(HUBS)]
    found = members.groupBy("bucket").agg(
        *[m.alias(f"m{i}") for i, m in enumerate(most)], F.min(F.struct(*fields)).alias("first")
    )
    names = [*(f"m{i}" for i in range(HUBS)), "first"]
    structs = [F.struct(*[F.col(f"{n}.{f}").alias(f) for f in fields]) for n in names]
    return small_side(found.select("bucket", F.array_distinct(F.array(*structs)).alias("hubs")), "hubs")


def _with_hubs(large: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of members and the hubs of their buckets, if they agree in enough sketches."""

    def wanted(x: Column) -> Column:
        fits = _similar_size(x["shingles"], F.col("shingles")) & (_agreement(x["sketches"], F.col("sketches")) >= AGREEMENT)
        return (x["id"] != F.col("id")) & fits

    own = F.filter("hubs", wanted)
    members = _by_bucket(large)
    met = members.join(_hubs(members), "bucket").select("id", F.explode(F.transform(own, lambda x: x["id"])).alias("hub"))
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def _random_pairs(large: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a < b`` of different classes in large buckets: members outside the main hub's class, and random leaders."""
    known = _by_bucket(large.join(classes, "id"))
    fields = F.struct("id", "shingles", "class_id", "sketches")

    def leader(i: int) -> Column:
        """The member with the smallest hash; every other one is of those that share most sketches."""
        order = F.struct(F.col("degree") * -(i % 2), F.xxhash64(F.lit(turn * LEADERS + i), "id", "bucket"))
        return F.min_by(fields, order).alias(f"l{i}")

    leaders = known.groupBy("bucket").agg(
        *map(leader, range(LEADERS)),
        F.max_by("class_id", F.struct("degree", "id")).alias("main"),
        (F.min("class_id") != F.max("class_id")).alias("live"),
    )
    names = [f"l{i}" for i in range(LEADERS)]
    leaders = leaders.where("live").select("bucket", "main", F.array_distinct(F.array(*names)).alias("leaders"))

    def wanted(x: Column) -> Column:
        return (x["class_id"] != F.col("class_id")) & _similar_size(x["shingles"], F.col("shingles"))

    def agreeing(x: Column) -> Column:
        return F.struct((-_agreement(x["sketches"], F.col("sketches"))).alias("differ"), x["id"].alias("leader"))

    met = F.filter(F.transform(F.filter("leaders", wanted), agreeing), lambda x: x["differ"] <= -AGREEMENT)
    # The nearest of a bucket are enough: what they miss is found in other buckets, by later rounds or by rare shingles.
    met = F.slice(F.sort_array(met), 1, NEAREST)
    nearest = (
        known.join(small_side(leaders, "leaders"), "bucket")
        .where("class_id <> main")
        .select("id", F.explode(met).alias("met"))
        .groupBy("id")
        .agg(F.slice(F.sort_array(F.collect_set("met")), 1, MEETINGS).alias("met"))
        .select("id", F.explode("met.leader").alias("leader"))
    )
    return nearest.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))


def _rarity(texts: DataFrame) -> np.ndarray:
    """How often shingles occur in ``texts``, by the first bits of their hash: a table of one size for any input."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _COUNTER_BITS, "i8")
        for batch in in_slices(batches):
            slots = (_labelled(batch.column(1).to_pylist())[2] >> np.uint64(64 - _COUNTER_BITS)).astype("i8")
            total += np.bincount(slots, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counts = texts.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << _COUNTER_BITS, "i8")
    out[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return out


def _may_reach(size: Column, at: Column, other_size: Column, other_at: Column) -> Column:
    """Whether two texts whose first common shingle is at these places can share enough for the similarity."""
    need = F.lit(SIMILARITY / (1 + SIMILARITY)) * (size + other_size) - F.lit(1e-6)
    return F.least(size - at, other_size - other_at) >= need


def _rare_pairs(large: DataFrame, bodies: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of different classes in large buckets that may have the similarity.

    All shingles are put in one order, rare ones first. Two texts of n and m shingles that reach a
    similarity of s share s / (1 + s) * (n + m) of them or more; behind their first common one, both have
    to have as many left, so it is among the first fifth of either. A passage that thousands share
    is behind the shingles that few have. Shingles whose texts are all of one class are left out. The
    others' texts are compared in blocks, those of the main class with those outside only.
    """
    live = _by_bucket(large.join(classes, "id")).groupBy("bucket")
    live = live.agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high").select("bucket")
    ids = _by_bucket(large).join(small_side(live, "live"), "bucket", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    texts = stage(bodies.join(small_side(ids, "open"), "doc_id"), "open-texts")
    rarity = _rarity(texts)

    def first_fifth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x, many = _labelled(batch.column(1).to_pylist())[2:]
            text = np.repeat(np.arange(len(many)), many)
            order = np.lexsort((x, rarity[(x >> np.uint64(64 - _COUNTER_BITS)).astype("i8")], text))
            at = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            size = np.repeat(many, many)
            keep = size - at >= SIMILARITY * size - 1e-6
            columns = (np.repeat(batch.column(0).to_numpy(), many), x[order].view("i8"), size, at)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in columns], ["id", "shingle", "size", "at"])

    firsts = texts.mapInArrow(first_fifth, "id long, shingle long, size long, at long").join(classes, "id")
    firsts = stage(firsts, "firsts")
    shared = firsts.groupBy("shingle").agg(
        F.count("*").alias("n"),
        F.max_by("class_id", F.struct("size", "id")).alias("main"),
        (F.min("class_id") != F.max("class_id")).alias("live"),
    )
    shared = small_side(shared.where("live").drop("live"), "shared")
    outside = firsts.join(shared, "shingle").withColumn("outside", F.col("class_id") != F.col("main"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = outside.select("*", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    # Members outside the main class stand still in their block, and every block visits those that have any: whole
    # blocks are rows here, so that their number grows with the square of a shingle's blocks and not of its members.
    fields = ("id", "class_id", "size", "at", "outside")
    held = dealt.groupBy("shingle", "block").agg(F.collect_list(F.struct(*fields)).alias("guests"))
    held = stage(held, "blocks")
    home = held.select("shingle", F.col("block").alias("visited"), F.filter("guests", lambda x: x["outside"]).alias("home"))
    home = home.where(F.size("home") > 0)
    occupied = home.groupBy("shingle").agg(F.collect_list("visited").alias("occupied"))
    visits = held.join(small_side(occupied, "occupied"), "shingle").select("shingle", "guests", F.explode("occupied").alias("visited"))
    met = visits.join(home, ["shingle", "visited"])

    def differing(x: Column) -> Column:
        """Guests that ``x`` has to be compared with; of two outside the main class the smaller id asks."""

        def wanted(y: Column) -> Column:
            once = ~y["outside"] | (x["id"] < y["id"])
            return once & (x["class_id"] != y["class_id"]) & _may_reach(x["size"], x["at"], y["size"], y["at"])

        return F.transform(
            F.filter("guests", wanted),
            lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")),
        )

    return met.select(F.explode(F.flatten(F.transform("home", differing))).alias("p")).select("p.a", "p.b")


def _merged(classes: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """Classes joined by further links between their members, and how many there are less."""
    for end in "ab":
        links = links.join(classes.select(F.col("id").alias(end), F.col("class_id").alias(f"class_{end}")), end)
    merged = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    merged = small_side(merged.select(F.col("id").alias("class_id"), F.col("class_id").alias("merged")), "merged")
    joined = classes.join(merged, "class_id", "left").select("id", F.coalesce("merged", "class_id").alias("class_id"))
    return small_side(joined, "classes"), merged.where("class_id <> merged").count()


def _bodies(own: DataFrame, texts: DataFrame, pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The texts that may be compared, each once; ``doc_id`` is the id of the text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    named = texts.select("id", "doc_id", "mark").join(small_side(ids, "wanted"), "id")
    found = own.join(small_side(named, "wanted-texts"), ["doc_id", "mark"])
    return stage(found.groupBy(F.col("id").alias("doc_id")).agg(F.min("text").alias("text")), "bodies")


def _linked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs that alignment confirms."""
    left = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    tested = left.join(pairs, "a").join(right, "b").select("a", "text_a", "b", "text_b")
    tested = tested.mapInArrow(_verify, "a long, b long, similarity double")
    return stage(tested.where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that have no id or the id and text that stay of their class.

    What stays of a class is a text with its smallest id; rows that repeat both stay too. A row is named by
    its id and a hash of its text, so none is lost because another text has its id.
    """
    judged = _judged(df, doc_id, text).where("doc_id is not null").groupBy("doc_id", "mark")
    gone = judged.agg(F.max("kept").alias("stays")).where("not stays")
    listed = stage(gone.select(F.col("doc_id").alias("id"), F.col("mark").alias("digest"), "stays"), "gone")
    return without(df, listed, doc_id, F.xxhash64(text_or_empty(text)))
