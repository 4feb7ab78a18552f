import random

import pytest
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions import treebank as tb
from litvec.functions.packing import Splitter, chunks


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


CASES = {
    "Don't stop, it's 5.5 mg (or 1,000).": "Do|n't|stop|,|it|'s|5.5|mg|(|or|1,000|)|.",
    'They said "we\'ll go", didn\'t they?': "They|said|``|we|'ll|go|''|,|did|n't|they|?",
    "I cannot; we're gonna.": "I|can|not|;|we|'re|gon|na|.",
    "'Twas the dogs' day -- 'quoted' too...": "'T|was|the|dogs|'|day|--|'|quoted|'|too|...",
    "Costs $5, 10% at 12:30: see U.S. law.": "Costs|$|5|,|10|%|at|12:30|:|see|U.S.|law|.",
    '("Inner") [x] {y} a.b. "End."': "(|``|Inner|''|)|[|x|]|{|y|}|a.b.|``|End|.|''",
    "CAN'T WON'T I'd've": "CA|N'T|WO|N'T|I|'d|'ve",
    "cannot cannot": "can|not|can|not",
    "été’s naïve—x": "été|’s|naïve—x",
    "": "",
    ".": ".",
    "x": "x",
}


def test_tokens(spark):
    found = column(spark, list(CASES), tb.treebank_tokens("t"))
    assert ["|".join(f) for f in found] == list(CASES.values())


def strange(n, seed=3):
    rnd = random.Random(seed)
    parts = [*"abcN'’\"().,:;-!?$% 5", "n't", "'s", "cannot", "...", "--", " '", "' ", "``", "é", "  ", "\n", "\t", " "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_spell_any_text_again(spark):
    values = strange(500) + list(CASES)
    joined = F.array_join(F.transform(tx.sentence_pieces("t"), lambda s: tb.spelled(tb.treebank_pieces(s))), "")
    assert column(spark, values, joined) == [" ".join(v.split()) for v in values]


def test_tokens_are_the_pieces_without_blanks(spark):
    values = [" ".join(v.split()) for v in strange(300, 4)]
    tokens = column(spark, values, tb.treebank_tokens("t"))
    pieces = column(spark, values, tb.treebank_pieces("t"))
    for t, p in zip(tokens, pieces):
        assert [x if x not in ("``", "''") or y.strip() != '"' else '"' for x, y in zip(t, p)] == [y.strip() for y in p if y.strip()]


def test_bare_tokens_read_like_print_again(spark):
    values = [
        "Don't stop, it's 5.5 mg (or 1,000).",
        'They said "we\'ll go", didn\'t they?',
        "I cannot; we're gonna: yes!",
        "Costs $5, 10% (see [x]).",
        '("Inner") and "more".',
        "",
        "Plain words",
    ]
    assert column(spark, values, tb.detokenize(tb.treebank_tokens("t"))) == values


def test_long_and_null(spark):
    found = column(spark, ["word, " * 100_000, None], F.size(tb.treebank_tokens("t")))
    assert found[0] == 200_000


@pytest.mark.parametrize("limit", [3, 7])
def test_chunks_count_treebank_tokens(spark, limit):
    splitter = Splitter(pieces=lambda s: F.transform(s, tb.treebank_pieces))
    text = "Don't go. It's (very) odd, isn't it? Yes."
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(chunks("t", limit, splitter).alias("c")).first().c
    sizes = df.select(F.transform(tx.sentence_pieces("t"), lambda s: F.size(tb.treebank_pieces(s))).alias("n")).first().n
    assert sum(c.n_tokens for c in got) == sum(sizes) and max(c.n_tokens for c in got) <= limit
    assert "".join(c.text for c in got).replace(" ", "") == text.replace(" ", "")


def test_rules_for_rare_parts_run_where_a_text_has_them(spark):
    texts = ["plain words .", "do n't CAN NOT go", "say `` so ''", "a ( b ) $ 5", "he ’s gon na , Lem Me", "“ x ” # 1", ""]
    df = spark.createDataFrame([(i, t.split(" ")) for i, t in enumerate(texts)], "id int, tokens array<string>")
    every = tb._replaced(F.array_join("tokens", " "), [r for _, rules in tb._JOINED for r in rules] + [(r"\A +| +\z", "")])
    rows = df.select(tb.detokenize("tokens").alias("a"), every.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[1].a == "don't CANNOT go"
