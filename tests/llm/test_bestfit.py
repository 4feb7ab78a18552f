import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litvec.llm import bestfit
from litvec.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole(path):
    tokenizer = tokenizers.Tokenizer.from_file(path)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, bestfit.END_ID]


def checked(found, rows, whole, window=2048):
    """Each document cut as told, sequences without gaps; returns their number."""
    by_doc, by_sequence = {}, {}
    for p in found:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in rows:
        ids = np.array(whole(text), "<u4")
        own = sorted(by_doc.pop(doc), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert [p.length for p in own[1:]] == [window] * (len(own) - 1) and 0 < own[0].length <= window
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
    assert not by_doc
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


ODD = [
    None, "", " ", "\n\t ", "It's. don't, x'll  12,3", "á \x1c!! \x85z", "<|endoftext|> a<|endoftext|>. b", "日本語 テキスト.",
    " " * 1_200_000, "x" * 100_000 + " y", "word " * 5000, " word" * 2047, " word" * 2048, " word" * 4095,
]


def test_ids_and_cuts_of_odd_texts(spark, path, whole):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sequence_id string, length int")
    checked(bestfit.best_fit(bestfit.pieces(df.repartition(3), path)).collect(), rows, whole)


def test_every_character_as_the_tokenizer_splits_it(path):
    encoder = bestfit.ByteEncoder(path)
    assert encoder.ranks is not None
    for low in range(0, 0x3000, 256):
        for text in (f"{a}. {a}1{a} {a}'s\n{a}  b{a}," for a in map(chr, range(low, low + 256))):
            assert np.array_equal(encoder(text), encoder._slow(text)), text


def test_a_file_of_another_kind_goes_through_its_own_tokenizer():
    other = vocabulary("word_bpe_49k.json")
    encoder = bestfit.ByteEncoder(other)
    assert encoder.ranks is None
    assert encoder("Some Text").tolist() == tokenizers.Tokenizer.from_file(other).encode("Some Text", add_special_tokens=False).ids


def test_given_documents_in_few_sequences(spark, path, whole):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    found = bestfit.best_fit(bestfit.pieces(df, path)).collect()
    used = checked(found, [(r.doc_id, r.text) for r in df.collect()], whole)
    assert used <= 1.02 * -(-sum(p.length for p in found) // 2048) + 1
    digests = bestfit.best_fit(bestfit.digests(bestfit.pieces(df, path))).collect()
    assert {(d.doc_id, d.piece, d.ids_crc32) for d in digests} == {(p.doc_id, p.piece, zlib.crc32(p.ids)) for p in found}
    assert len({d.sequence_id for d in digests}) <= used * 1.02 + 1


def by_hand(lengths, window):
    """Best fit by looking at all open sequences."""
    rooms = []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.sampled_from([50, 64, 63, 97]))
def test_tree_finds_the_tightest_sequence(lengths, window):
    fit, filled = bestfit.TightestFit(window), {}
    lengths = sorted(lengths, reverse=True)
    for n in lengths:
        sequence, offset = fit.place(n)
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + n
    assert sorted(window - f for f in filled.values()) == by_hand(lengths, window)


def test_groups_of_any_size_ties_null_ids_empty_table_and_lengths_out_of_range(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 100 + 1).alias("length"), F.lit("x").alias("offset"), F.lit(1).alias("row")
    )
    for group in (50, 370, 10_000):
        found = bestfit.best_fit(df, window=100, group=group)
        assert found.columns == ["doc_id", "length", "row", "sequence_id", "offset"]
        full = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
        assert found.count() == 5000 and full.where("n > 100 or n <> e").isEmpty()
    assert full.count() == -(-5000 * 101 // 2 // 100)  # lengths of x and 100 - x fill windows
    assert bestfit.best_fit(df.limit(0)).count() == 0
    assert bestfit.pieces(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).count() == 0
    for bad in (0, 101, None):
        with pytest.raises(Exception, match="length must be"):
            bestfit.best_fit(spark.createDataFrame([(bad,)], "length long"), window=100).count()
