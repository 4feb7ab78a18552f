import pytest
from pyspark.sql import functions as F

from litvec.functions import text as tx


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def every_space():
    return [c for c in map(chr, range(0x3100)) if c.isspace()]


def test_strip_removes_what_python_strips(spark):
    values = [f"{c}a{c}b{c}{c}" for c in every_space()] + ["", " \t ", "​x​"]
    assert column(spark, values, tx.strip("t")) == [v.strip() for v in values]


def test_single_spaced(spark):
    values = [f"{c} a{c}{c}b {c}" for c in every_space()] + ["a b", "", " "]
    assert column(spark, values, tx.single_spaced("t")) == [" ".join(v.split()) for v in values]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_word_count_follows_python_split(spark, n):
    words = ["", " ", "a", "a b c d e", "a b c d e f", " a\tb c d\ne  f ", "a" * 5000, "é ü ß ñ ç à"]
    words += [f"a{c}b{c}c{c}d{c}e{c}f" for c in every_space()]
    assert column(spark, words, tx.has_more_words_than("t", n)) == [len(w.split()) > n for w in words]


def test_end_marks(spark):
    values = ["a!", "a,", "a.", "a?", 'a"', "a'", "a", "a;", "a)", ""]
    expected = ["a!", "a,", "a.", "a?", 'a"', "a'", "a.", "a;.", "a).", "."]
    assert column(spark, values, tx.with_end_mark("t")) == expected


def test_sections_are_lower_and_stripped(spark):
    assert column(spark, [" ABSTRACT\t", "Results ", None], tx.normalise_section("t")) == ["abstract", "results", None]


def test_sentences(spark):
    values = ["One. Two!  Three?\nFour", "v1.2 is out. ok", "a.. b", "", "  ", "no end", "He said \"x.\" Then"]
    expected = [
        ["One.", "Two!", "Three?", "Four"],
        ["v1.2 is out.", "ok"],
        ["a..", "b"],
        [],
        [],
        ["no end"],
        ['He said "x." Then'],
    ]
    assert column(spark, values, tx.sentences("t")) == expected


def test_tokens(spark):
    values = ["It's 3.5 mg/ml, naïve_x!", "", "été ß"]
    expected = [["It", "'", "s", "3", ".", "5", "mg", "/", "ml", ",", "naïve_x", "!"], [], ["été", "ß"]]
    assert column(spark, values, tx.tokens("t")) == expected


def test_pieces_spell_the_text_again(spark):
    values = ["It's (very) odd...  Is it?\tYes, 3.5 mg!", "x"]
    joined = F.array_join(F.flatten(F.transform(tx.sentence_pieces("t"), tx.token_pieces)), "")
    assert column(spark, values, joined) == [" ".join(v.split()) for v in values]


def test_dates(spark):
    lenient = column(spark, ["2015-06-18T00:00:00Z", "2015-06-18", "soon", None], tx.parse_date("t"))
    assert [str(d) for d in lenient] == ["2015-06-18 00:00:00", "2015-06-18 00:00:00", "None", "None"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        column(spark, ["soon"], tx.parse_date("t", strict=True))


def test_null_authors_are_skipped(spark):
    df = spark.createDataFrame([(["A", None, "B"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(tx.joined_authors("a")).collect()] == ["A and B", ""]
