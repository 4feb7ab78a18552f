"""Heterogeneous chat records as canonical turns, formatted by a template that can be read back.

A record's layout is recognised by a fingerprint, the hash of the nested field paths that it
fills. Each fingerprint selects a declared mapping to turns of a role and a text.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every field that some layout knows; other fields of a record are ignored.
RECORD = (
    "turns array<struct<turn:bigint,role:string,text:string>>, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<`from`:string,value:string>>, system string, instruction string, input string, "
    "output string, prompt string, response string, completion string, question string, answer string"
)
_LISTS = {"turns": ("turn", "role", "text"), "messages": ("role", "content"), "conversations": ("from", "value")}
_FIELDS = ("system", "instruction", "input", "output", "prompt", "response", "completion", "question", "answer")
# The reader stops at strings of 20 million characters unless told otherwise; a cell holds 2 GB.
JSON = {"maxStringLen": str((1 << 31) - 1)}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Layout: paths that have to be there, paths that may be.
LAYOUTS = {
    "rows": (("turns",), ("turns[].turn", "turns[].role", "turns[].text")),
    "messages": (("messages",), ("messages[].role", "messages[].content", "system")),
    "conversations": (("conversations",), ("conversations[].from", "conversations[].value", "system")),
    "instruction": (("instruction", "output"), ("input", "system")),
    "prompt_response": (("prompt", "response"), ("system",)),
    "prompt_completion": (("prompt", "completion"), ("system",)),
    "question_answer": (("question", "answer"), ("system",)),
}

# The template. Inside roles and texts no "<|" is left, so the marks are found again.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common templates get a backslash behind their first character, one more if they have some.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def _hash(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layouts_by_fingerprint() -> dict[str, str]:
    """Fingerprint of every set of paths that a layout allows."""
    return {
        _hash([*needed, *more]): name
        for name, (needed, optional) in LAYOUTS.items()
        for n in range(len(optional) + 1)
        for more in combinations(optional, n)
    }


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths that a record (a struct like ``RECORD``) fills."""

    def inside(name: str, field: str) -> Column:
        return F.when(F.exists(record[name], lambda x: x[field].isNotNull()), F.lit(f"{name}[].{field}"))

    paths = [F.when(record[name].isNotNull(), F.lit(name)) for name in _LISTS]
    paths += [inside(name, field) for name, fields in _LISTS.items() for field in fields]
    paths += [F.when(record[name].isNotNull(), F.lit(name)) for name in _FIELDS]
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, layout: str) -> Column:
    system = F.when(record["system"].isNotNull(), F.array(_turn(F.lit("system"), record["system"]))).otherwise(F.array())
    aliases = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def pair(asked: Column, answered: Column) -> Column:
        return F.concat(system, F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), answered)))

    if layout == "rows":
        return F.transform(F.array_sort(record["turns"]), lambda x: _turn(x["role"], x["text"]))
    if layout == "messages":
        return F.concat(system, F.transform(record["messages"], lambda x: _turn(x["role"], x["content"])))
    if layout == "conversations":
        named = lambda x: F.coalesce(aliases[x["from"]], x["from"])
        return F.concat(system, F.transform(record["conversations"], lambda x: _turn(named(x), x["value"])))
    if layout == "instruction":
        return pair(F.concat_ws("\n", record["instruction"], F.when(record["input"] != "", record["input"])), record["output"])
    asked, answered = LAYOUTS[layout][0]
    return pair(record[asked], record[answered])


def canonical_turns(df: DataFrame, json: str = "record") -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (role and text) of the JSON records in a column.

    A layout that no mapping declares, broken JSON and a null record have a null layout and null
    turns; the row stays. Roles and texts that are null or missing become empty. Turns of the
    rows layout are ordered by turn, null first, then role and text; other lists keep their order.
    Other columns are kept, those named ``layout`` or ``turns`` are replaced.
    """
    known = layouts_by_fingerprint()
    parsed = df.select(F.struct("*").alias("own"), F.from_json(F.col(json), RECORD, JSON).alias("record"))
    marked = parsed.select("own", "record", fingerprint(F.col("record")).alias("fingerprint"))
    layout = F.coalesce(
        *[
            F.when(F.col("fingerprint").isin([f for f, n in known.items() if n == name]), F.lit(name))
            for name in LAYOUTS
        ]
    )
    chosen = marked.select("own", "record", layout.alias("layout"))
    turns = F.coalesce(*[F.when(F.col("layout") == n, _mapped(F.col("record"), n)) for n in LAYOUTS])
    return chosen.select(*_others(df, "layout", "turns"), "layout", turns.alias("turns"))


def _others(df: DataFrame, *replaced: str) -> list[Column]:
    """The caller's columns, packed in ``own`` so that no name of theirs meets one of ours."""
    return [F.col("own").getField(c).alias(c) for c in df.columns if c.lower() not in replaced]


def rows_to_records(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows of ``turn, role, text`` as one JSON record per key, in the rows layout.

    A conversation is one record, so all its rows, and all rows with a null key, which are one
    conversation, meet in one task. The record has to fit into a cell: 2 GB of JSON, where control
    characters, quotes and backslashes take two to six bytes. A single text has no other bound.
    """
    return (
        rows.groupBy(key)
        .agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")).alias("turns"))
        .select(key, F.to_json(F.struct("turns")).alias("record"))
    )


def formatted(df: DataFrame) -> DataFrame:
    """``df`` with ``chat``, the turns as one text, and ``loss``, where assistant texts lie in it.

    ``loss`` lists spans (start, end) in code points, end exclusive. No turns give an empty text
    and no span, null turns a null text.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learned"),
        ),
    )
    with_pieces = df.select(F.struct("*").alias("own"), pieces.alias("pieces"))

    def following(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(p["learned"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return with_pieces.select(
        *_others(df, "chat", "loss"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("chat"),
        F.aggregate("pieces", first, following, lambda s: s["spans"]).alias("loss"),
    )


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with ``turns`` and ``learned`` (the text under the loss mask), taken from ``chat`` and ``loss`` alone."""
    own = [c for c in df.columns if c not in ("turns", "learned")]
    parts = F.slice(F.split("chat", TURN.replace("|", r"\|")), 2, 1 << 30)

    def turn(part: Column) -> Column:
        halves = F.split(part, TEXT.replace("|", r"\|"))
        role, body = halves[0], halves[1]
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text")
        )

    under = F.transform("loss", lambda s: unescape(F.substring("chat", s["start"] + 1, s["end"] - s["start"])))
    return df.select(*own, F.transform(parts, turn).alias("turns"), F.array_join(under, "").alias("learned"))
