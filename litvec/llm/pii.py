"""Personal data: base patterns, and identifiers found by the contexts in which these occur.

Matches of the base patterns are the seeds. The words before a seed and the word behind it are
lexical patterns; patterns and the identifier-like tokens in them form a graph that is scored in
turns. A token that several good patterns point to is an identifier that no base pattern describes.
Column expressions and aggregates only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions.columns import let
from litvec.llm.common import text_or_empty
from litvec.runtime import stage

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that a failing start is not tried again inside the same run of characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Tokens that may be identifiers hold a digit or an @; punctuation around them is not part of them.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_TRIM_LEFT, _TRIM_RIGHT = r"^[\"'(\[<{,;:!?]++", r"(?<![\"')\]>},;:!?.])[\"')\]>},;:!?.]++$"
TURNS = 3
SUPPORT = 5  # different seeds that a pattern must have met
CONFIDENCE = 0.8
BLOCK = 64  # matches whose places are summed together
REACH = 48  # a pattern is made of the words within so many characters on either side
PIECE = 1024  # a context is cut from a piece of the text, not from its start


def _spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string>>")


def _placed(pairs: Column, start: Column) -> Column:
    """Spans of a few pairs of a match and the text before it, the first of which begins at ``start``."""
    first = F.struct(start.cast("int").alias("at"), _spans().alias("spans"))

    def following(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["between"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    return F.aggregate(pairs, first, following, lambda s: s["spans"])


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right, none overlapping: array of ``start, end, found`` in code points, end exclusive.

    Places are summed over the lengths of matches and of the text between them. Appending copies
    a list, so the sums run over blocks and then inside each block.
    """

    def summed(pairs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")),
            lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)),
        )
        sizes = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["found"]) + F.length(x["between"]))
        starts = lambda bs: F.aggregate(
            bs, F.array(F.lit(0)), lambda done, b: F.array_append(done, F.element_at(done, -1) + sizes(b))
        )
        placed = let(
            blocks,
            lambda bs: let(starts(bs), lambda at: F.transform(bs, lambda b, i: _placed(b, F.get(at, i)))),
        )
        return F.when(F.size(pairs) > 0, F.flatten(placed)).otherwise(_spans())

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pair = lambda f, b: F.struct(f.alias("found"), b.alias("between"))
    return let(
        F.struct(found.alias("found"), between.alias("between")),
        lambda x: let(F.zip_with(x["found"], F.slice(x["between"], F.lit(1), F.size(x["found"])), pair), summed),
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(_digits(found)).between(12, 19) & F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a base pattern. Texts that cannot hold one are not searched."""
    needed = _NEEDS[kind]
    may = F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9]")
    return F.when(may, F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["found"]))).otherwise(_spans())


def _pieces(text: Column) -> Column:
    """The text in pieces of one length in code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, length: Column) -> Column:
    """A substring of less than a piece, from the two pieces that it may lie in."""
    first = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
    return F.substring(two, start % PIECE + 1, length)


def _context(pieces: Column, start: Column, end: Column) -> Column:
    """The two words before and the word behind, as lexical patterns; digits are alike, punctuation at the rim is not."""
    before = _cut(pieces, F.greatest(start - REACH, F.lit(0)), F.least(start, F.lit(REACH)))
    behind = _cut(pieces, end, F.lit(REACH))
    left = F.regexp_replace(F.lower(F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)), "[0-9]", "0")
    right = F.regexp_replace(F.lower(F.regexp_extract(behind, r"^\S*\s+(\S+)", 1)), "[0-9]", "0")
    return F.array_compact(
        F.array(
            F.when(left != "", F.concat(F.lit("< "), F.regexp_replace(left, r"\s+", " "))),
            F.when((left != "") & (right != ""), F.concat(F.lit("<> "), F.regexp_replace(left, r"\s+", " "), F.lit(" _ "), right)),
        )
    )


def _shape(token: Column) -> Column:
    """The kind that a token may be by its characters alone, else null."""
    digits = F.length(_digits(token))
    dotted = token.rlike("^[0-9][0-9.]*[0-9]$") & token.rlike(r"\.[0-9]+\.") & ~F.contains(token, F.lit(".."))
    return (
        F.when(F.contains(token, F.lit("@")), "email")
        .when(dotted, "ip")
        .when(token.rlike("^[0-9 -]+$") & (digits >= 12), "card")
        .when(token.rlike("^[+0-9().-]+$") & digits.between(7, 15), "phone")
    )


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of ``spans``, which ascend and do not overlap, has a place in common: the last that begins before ``end``."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        upper = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        lower = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(spans, middle)["start"] < end, upper).otherwise(lower)

    whole = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    turns = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
    last = F.aggregate(turns, whole, halved, lambda s: F.get(spans, s["low"] - 1))
    return (F.size(spans) > 0) & F.coalesce(last["end"] > start, F.lit(False))


def _candidates(text: Column, base: list[Column]) -> Column:
    """Identifier-like tokens outside all base spans: ``start, end, found, kind``, trimmed of punctuation."""

    def trimmed(m: Column) -> Column:
        left = F.regexp_replace(m["found"], _TRIM_LEFT, "")
        start = m["end"] - F.length(left)
        found = F.regexp_replace(left, _TRIM_RIGHT, "")
        return F.struct(
            start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), _shape(found).alias("kind")
        )

    return F.filter(
        F.transform(matches(text, TOKEN), trimmed),
        lambda c: c["kind"].isNotNull() & ~reduce(or_, [_overlaps(spans, c["start"], c["end"]) for spans in base]),
    )


def discovered(rows: DataFrame) -> DataFrame:
    """Occurrences of identifiers that only their contexts show: ``row, kind, start, end``.

    ``rows`` has ``row`` and the array ``seen`` of ``kind, start, end, found, seed, patterns``. A
    pattern's confidence for a kind is the score of that kind's instances over all instances in
    it, smoothed by two; an instance's score is the chance that one of its patterns is right.
    Only different values count, so copies of a text weigh once; counts are made in map tasks
    before the shuffle. Patterns need several seeds, so a chance context finds nothing.
    """
    seen = rows.select("row", F.explode("seen").alias("o")).select("row", "o.*")
    edges = stage(
        seen.select("kind", F.sha2("found", 256).alias("value"), "seed", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "value")
        .agg(F.max("seed").alias("seed")),
        "edges",
    )
    supported = (
        edges.groupBy("pattern", "kind")
        .agg(F.sum(F.col("seed").cast("int")).alias("seeds"))
        .where(F.col("seeds") >= SUPPORT)
        .select("pattern", "kind")
    )
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    known = stage(supported.join(totals, "pattern"), "patterns")
    graph = stage(edges.join(known, ["pattern", "kind"]), "graph")
    score = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = graph.withColumn("score", score)
    for _ in range(TURNS):
        patterns = scored.groupBy("pattern", "kind").agg((F.sum("score") / (F.first("total") + 2)).alias("confidence"))
        instances = (
            graph.join(patterns, ["pattern", "kind"])
            .groupBy("kind", "value")
            .agg(
                F.max("seed").alias("is_seed"),
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("found_score"),
            )
        )
        scored = stage(
            graph.join(
                instances.select("kind", "value", F.when(F.col("is_seed"), 1.0).otherwise(F.col("found_score")).alias("score")),
                ["kind", "value"],
            ),
            "scored",
        )
    good = scored.where(~F.col("seed") & (F.col("score") >= CONFIDENCE)).select("kind", "value").distinct()
    fresh = seen.where(~F.col("seed")).select("row", "kind", "start", "end", F.sha2("found", 256).alias("value"))
    return fresh.join(stage(good, "identifiers"), ["kind", "value"], "left_semi").select("row", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: ``doc_id``, ``base`` and ``extra`` (arrays of ``kind, start, end``).

    Whole texts are read; a null text counts as empty, a null id stays, rows that repeat are
    judged each, an empty table gives an empty one. ``base`` holds the valid matches of the base
    patterns, ``extra`` what contexts add; no extra span overlaps a base span. The work for a text grows
    with its identifiers and their logarithm; a context is the words within ``REACH`` characters.
    """
    body = F.col("body")
    first = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body"))
    based = first.select("doc_id", "body", *[base_spans(body, k).alias(k) for k in KINDS])
    may = body.rlike("[0-9@]")
    fresh = F.when(may, _candidates(body, [F.col(k) for k in KINDS]))

    def occurrence(kind: Column, span: Column, seed: bool) -> Column:
        return F.struct(
            kind.alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["found"].alias("found"),
            F.lit(seed).alias("seed"),
            _context(F.col("pieces"), span["start"], span["end"]).alias("patterns"),
        )

    def seeds_of(kind: str) -> Column:
        return F.transform(kind, lambda s: occurrence(F.lit(kind), s, True))

    seeds = F.concat(*map(seeds_of, KINDS))
    unseen = F.transform("fresh", lambda s: occurrence(s["kind"], s, False))
    rows = stage(
        based.select("*", fresh.alias("fresh"), F.when(may, _pieces(body)).alias("pieces")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.concat(seeds, F.coalesce(unseen, F.array().cast("array<struct<kind:string,start:int,end:int,found:string,seed:boolean,patterns:array<string>>>"))).alias("seen"),
        ),
        "seen",
    )
    extra = (
        discovered(rows)
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    )
    base = F.transform(F.filter("seen", lambda o: o["seed"]), lambda o: F.struct(o["kind"], o["start"], o["end"]))
    return rows.join(stage(extra, "extra"), "row", "left").select(
        "doc_id",
        base.cast("array<struct<kind:string,start:int,end:int>>").alias("base"),
        F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("extra"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "extra")).alias("spans"),
    )
