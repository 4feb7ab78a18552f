import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from litvec.llm import exact


def by_hand(rows):
    texts = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    size = Counter(t for _, t in texts)
    keep = {t: min((d for d, s in texts if s == t and d is not None), default=None) for t in size}
    return sorted(((d, keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in texts), key=str)


def judged(df):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_duplicates(df).collect()]
    return sorted(rows, key=str)


def test_against_comparison_of_whole_texts(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("aemiu é\n\t-xyz ") for _ in range(n)) for n in (0, 1, 900, 1500, 5000, 40_000)]
    rows = [(i, rnd.choice(base)) for i in range(60)]
    rows += [(100 + i, t.replace(" ", "  \r\n")) for i, t in enumerate(base)]
    rows += [(200 + i, t[:-1] + "!") for i, t in enumerate(base) if t]
    rows += [(300, None), (301, ""), (302, " \u00a0"), (None, "a"), (None, "a"), (400, "x" * 300_000)]
    found = judged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == by_hand(rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b"), (3, "a  b"), (3, "a\nb"), (None, "a b"), (None, "only"), (None, "only"), (7, None), (8, "")]
    found = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(((r.doc_id, r.keep_id) for r in found if r.kept), key=str)
    assert kept == sorted([(3, 3), (7, 7), (None, None)], key=str)


def test_chunks_are_the_whole_text_and_survive_edits(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(60_000))
    df = spark.createDataFrame([(text,), ("inserted " + text,), ("é" * 50_000,), ("",)], "text string")
    first, second, third, empty = (r.c for r in df.select(exact.chunks(F.col("text")).alias("c")).collect())
    assert "".join(first) == text and "".join(third) == "é" * 50_000 and empty == []
    assert len(set(first) & set(second)) > 0.7 * len(first)
    assert max(map(len, first + third)) <= exact.LONGEST


def test_colliding_keys_are_told_apart_by_proofs(spark):
    rows = spark.createDataFrame(
        [(0, 1, "s1", [7, 8], ["p", "q"]), (1, 2, "s2", [7, 8], ["r", "q"]), (2, 3, "s3", [8], ["q"])],
        "row long, doc_id long, text_sha256 string, keys array<long>, proofs array<string>",
    )
    ids = {r.doc_id: r.ids for r in exact.identified(rows).collect()}
    assert ids == {1: ["p", "q"], 2: ["r", "q"], 3: ["8"]}
    store = {(r.key, r.proof): r.copies for r in exact.chunk_store(rows).collect()}
    assert store == {(7, "p"): 1, (7, "r"): 1, (8, "q"): 3}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 1, "y")], "doc_id long, text string, row int, ids string")
    assert [(r.doc_id, r.ids) for r in exact.drop_duplicates(df).collect()] == [(1, "x")]
    assert exact.drop_duplicates(df).columns == df.columns
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_a_third_of_the_rows_in_one_group(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 1, 'the same text', concat('text ', id)) as text")
    found = exact.exact_duplicates(df)
    assert found.where("group_size = 2000 and keep_id = 1").count() == 2000
    assert found.where("kept").count() == 4001


def test_the_stage_keeps_one_row_of_every_group(spark):
    rows = [
        (1, "twice"), (1, "twice"), (2, "twice"),  # the smallest id of a group comes twice
        (3, "alone, twice"), (3, "alone,  twice"),
        (4, "first of four"), (5, "first of four"), (5, "second of five"),  # an id of two texts, one of them a copy
        (None, "no id"), (None, "no id"), (None, "another"), (None, "second of five"), (6, None), (None, ""),
    ]
    df = spark.createDataFrame([(*r, i, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, own int, digest map<string,int>")
    kept = exact.drop_duplicates(df.repartition(3))
    assert kept.schema == df.schema
    found = sorted(((r.doc_id, exact_spaces(r.text)) for r in kept.collect()), key=str)
    wanted = [(1, "twice"), (3, "alone, twice"), (4, "first of four"), (5, "second of five"), (6, ""), (None, "no id"), (None, "another")]
    assert found == sorted(wanted, key=str)
    judged_rows = [r for r in exact.exact_duplicates(df).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in judged_rows) == sorted(str(d) for d, _ in wanted)


def exact_spaces(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
