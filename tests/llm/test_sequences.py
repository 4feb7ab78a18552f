import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litvec.llm import sequences
from litvec.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, sequences.END_ID]


def checked(pieces, rows, whole, window=2048):
    """Every id in exactly one piece, sequences without gaps; returns padding and number of sequences."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in rows:
        ids = np.array(whole(text), "<u4")
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert bytes(p.ids) == ids[at : at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding, len(by_sequence)


ODD = [
    None, "", " ", "\n\t ", "It's. don't, x'll", "a\u0301 e\u0301. \x1c!! \x85z \x0bq", "<|endoftext|> a<|endoftext|>. b",
    "\u00a0b\u2003c 12,3 ...", "Σας ΣΑΣ İstanbul K ǅ ﬁ straßE ª. Ǆ,", "日本語 テキスト.", "x" * 100 + " y", "a.b.c, d,", "word " * 5000,
]


def test_ids_as_the_tokenizer_gives_them(spark, whole):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    checked(sequences.pack(df, vocabulary()).collect(), rows, whole)


def test_given_documents_with_little_padding(spark, whole):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(2, "doc_id")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    pieces = sequences.pack(df, vocabulary()).collect()
    padding, _ = checked(pieces, rows, whole)
    assert padding < 0.03 * sum(p.length for p in pieces)
    digests = sequences.digests(sequences.pack(df, vocabulary())).collect()
    assert {(d.doc_id, d.start, d.ids_crc32) for d in digests} == {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces}


def test_small_blocks_empty_table_null_ids_and_other_columns(spark, whole):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int")
    checked(sequences.pack(df.coalesce(1), vocabulary(), block_tokens=500).collect(), rows, whole)
    assert sequences.pack(df.limit(0), vocabulary()).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "doc_id long, text string")
    assert [p.doc_id for p in sequences.pack(twice, vocabulary()).collect()].count(None) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([(64, 4), (128, 16), (100, 8)]))
def test_any_lengths(lengths, shape):
    window, step = shape
    p = sequences.pack_lengths(np.array(lengths, "i8"), window, step)
    for d, n in enumerate(lengths):
        mine = sorted(zip(p["start"][p["doc"] == d], p["length"][p["doc"] == d]))
        assert [s for s, _ in mine] == [0, *np.cumsum([x for _, x in mine])[:-1]]
        assert sum(x for _, x in mine) == n
    for s in set(p["sequence"].tolist()):
        mine = sorted(zip(p["offset"][p["sequence"] == s], p["length"][p["sequence"] == s]))
        assert [o for o, _ in mine] == [0, *np.cumsum([x for _, x in mine])[:-1]]
        assert sum(x for _, x in mine) <= window


def test_many_equal_lengths_waste_nothing():
    p = sequences.pack_lengths(np.full(10_000, 1500))
    used = np.bincount(p["sequence"], p["length"]).astype(int)
    assert sum(2048 - u for u in used if u & (u - 1)) == 0


def test_least_squares_against_trials():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6) * 10
        x = sequences.non_negative_least_squares(a, b)
        best = np.linalg.norm(a @ x - b)
        assert (x >= 0).all()
        for _ in range(200):
            other = np.maximum(x + rng.normal(0, 0.3, 9), 0)
            assert np.linalg.norm(a @ other - b) >= best - 1e-6


def test_words_are_forgotten_without_harm(monkeypatch, whole):
    monkeypatch.setattr(sequences, "_WORDS_KEPT", 40)
    encoder = sequences.WordEncoder(vocabulary())
    texts = [f"one two{i} three, four{i}. five{i % 3}" for i in range(100)]
    got = [x for i in range(0, 100, 3) for x in encoder(texts[i : i + 3])]
    assert [x.tolist() for x in got] == [whole(t)[:-1] for t in texts]


def test_ids_of_every_character_before_a_mark_a_letter_and_a_blank(whole):
    encoder = sequences.WordEncoder(vocabulary())
    characters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(characters), 2000):
        texts = [f"{c}. x a{c}, {c}{c}. {c}b {c}, a.{c} é{c}." for c in characters[a : a + 2000]]
        wanted = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for text, ids, other in zip(texts, encoder(texts), wanted):
            assert ids.tolist() == other.ids, text
    assert encoder(["İ. x"])[0].tolist() == whole("İ. x")[:-1]


def test_ids_of_random_mixes():
    rnd = random.Random(9)
    parts = [*"aÀéßµªİıſKǅﬁΣςक़़\u0301\u0307.,'!1 \n日ंि", "word", "'s", "...", "</w>", " ", " "]
    encoder = sequences.WordEncoder(vocabulary())
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    wanted = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for text, ids, other in zip(texts, encoder(texts), wanted):
        assert ids.tolist() == other.ids, text
