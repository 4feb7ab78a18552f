from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

import pytest

from litvec.functions import packing
from litvec.functions.packing import chunks, fixed_slices, pack_spans


def greedy(sizes, limit):
    """The packing rule, one sentence at a time."""
    spans, start, length = [], 0, 0
    for n in sizes:
        if length + n <= limit:
            length += n
            continue
        if length:
            spans.append((start, length))
        start += length
        length = n
        if n > limit:
            spans += [(start + i, min(limit, n - i)) for i in range(0, n, limit)]
            start, length = start + n, 0
    return spans + ([(start, length)] if length else [])


def spans_of(spark, sizes, limit):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<int>")
    rows = df.select("i", pack_spans(F.col("s"), limit).alias("p")).orderBy("i").collect()
    return [[tuple(p) for p in r["p"]] for r in rows]


def test_known_sizes(spark):
    sizes = [[3, 3, 3], [100], [101], [250, 1], [50, 50, 1], [0], [], [99, 250, 3, 100]]
    assert spans_of(spark, sizes, 100) == [
        [(0, 9)],
        [(0, 100)],
        [(0, 100), (100, 1)],
        [(0, 100), (100, 100), (200, 50), (250, 1)],
        [(0, 100), (100, 1)],
        [],
        [],
        [(0, 99), (99, 100), (199, 100), (299, 50), (349, 3), (352, 100)],
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.lists(hs.integers(0, 30), max_size=40), min_size=1, max_size=20), hs.integers(1, 25))
def test_fold_equals_greedy(spark, sizes, limit):
    found = spans_of(spark, sizes, limit)
    assert found == [greedy(s, limit) for s in sizes]
    for size, spans in zip(sizes, found):
        assert all(0 < n <= limit for _, n in spans)
        assert sum(n for _, n in spans) == sum(size)


def test_long_texts_cross_fold_borders(spark, monkeypatch):
    sizes = [[(i * 7) % 13 for i in range(n)] for n in (3, 4, 5, 8, 9, 100)]
    whole = spans_of(spark, sizes, 10)
    monkeypatch.setattr(packing, "_FOLD", 4)
    assert spans_of(spark, sizes, 10) == whole == [greedy(s, 10) for s in sizes]


def test_chunks_keep_sentences_and_spelling(spark):
    text = "Hello,  world.  It's\tfine! One two three four five six seven. Ok"
    df = spark.createDataFrame([(text,), ("",), (" \n",)], "t string")
    rows = [[tuple(c) for c in r[0]] for r in df.select(chunks("t", 5)).collect()]
    assert rows == [
        [("Hello, world.", 4), ("It's fine!", 5), ("One two three four five", 5), ("six seven.", 3), ("Ok", 1)],
        [],
        [],
    ]


def test_long_text_is_packed_in_reasonable_time(spark):
    """A text of many megabytes in one cell: the fold must not grow with the square of its length."""
    text = "Some words make a sentence of nine tokens here. " * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(F.explode(chunks("t", 100)).alias("c")).agg(F.count("*"), F.sum("c.n_tokens")).first()
    assert tuple(row) == (20_000, 2_000_000)


def test_fixed_slices(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(fixed_slices("a", 2)).collect()] == [[[1, 2], [3, 4], [5]], [[1, 2]], []]


def test_limits_must_be_positive():
    for broken in (lambda: pack_spans(F.col("s"), 0), lambda: fixed_slices("a", 0)):
        with pytest.raises(ValueError):
            broken()
