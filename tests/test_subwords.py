import random

import pytest
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions.packing import chunks
from litvec.functions.subwords import WordPieces, read_vocabulary, trie
from litvec.operators.embedding import truncate_subwords


def table(spark, pieces):
    return spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, id int")


def by_hand(token, vocabulary, inside="##", end=""):
    out, a, word = [], 0, token.lower()
    while a < len(word):
        for b in range(len(word), a, -1):
            key = (inside if a else "") + word[a:b] + (end if b == len(word) else "")
            if key in vocabulary:
                out.append(key)
                a = b
                break
        else:
            return ["[UNK]"]
    return out


VOCABULARY = ["[UNK]", "un", "##able", "##a", "##ab", "able", "a", "b", "##b", "##l", "##e", "under", "##stand", "##ing", "é", "##é", ",", "."]


def test_known_cuts(spark):
    cut = WordPieces.of(table(spark, VOCABULARY))
    keys = lambda t: [p[2] for p in cut.cut(t)]
    assert keys("Unable") == ["un", "##able"] and keys("understanding") == ["under", "##stand", "##ing"]
    assert keys("unabx") == ["[UNK]"] and keys("ablé") == ["a", "##b", "##l", "##é"] and keys("Éa") == ["é", "##a"] and keys("") == []
    assert [p[3] for p in cut.cut("ab")] == [6, 8] and cut.cut("x")[0] == (0, 1, "[UNK]", 0)


@pytest.mark.parametrize("end", ["", "</w>"])
def test_against_trying_every_length(spark, end):
    rnd = random.Random(4)
    keys = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4))) for _ in range(60)}
    vocabulary = {*keys, *("##" + k for k in keys if rnd.random() < 0.8), *(k + "</w>" for k in keys), *("##" + k + "</w>" for k in keys)}
    cut = WordPieces.of(table(spark, sorted(vocabulary)), end=end)
    words = ["".join(rnd.choice("abcéD") for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    assert [[p[2] for p in cut.cut(w)] for w in words] == [by_hand(w, vocabulary, end=end) for w in words]
    rows = spark.createDataFrame([(i, words[i : i + 7]) for i in range(0, 600, 7)] + [(-1, []), (-2, None)], "i int, t array<string>")
    got = {r.i: r.p for r in rows.repartition(3).select("i", cut.pieces("t").alias("p")).collect()}
    assert got[-1] == [] and got[-2] is None
    for i in range(0, 600, 7):
        assert [p.piece for p in got[i]] == [k for w in words[i : i + 7] for k in by_hand(w, vocabulary, end=end)]


def test_trie_holds_every_beginning(spark):
    rows = {r.prefix: r.id for r in trie(table(spark, ["ab", "abcd", "x", "ab", ""])).collect()}
    assert rows == {"a": None, "ab": 0, "abc": None, "abcd": 1, "x": 2}
    with pytest.raises(ValueError, match="more than 2"):
        WordPieces.of(table(spark, ["abc"]), most=2)


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[UNK]\nun\n##able\n\nx\n", encoding="utf-8")
    assert [(r.piece, r.id) for r in read_vocabulary(spark, str(tmp_path / "vocab.txt")).orderBy("id").collect()] == [
        ("[UNK]", 0),
        ("un", 1),
        ("##able", 2),
        ("x", 4),
    ]


def test_truncation_and_mask_count_pieces(spark):
    cut = WordPieces.of(table(spark, VOCABULARY))
    rows = [(1, "g", "Unable, understanding."), (2, "g", "able"), (3, None, None), (4, None, ""), (5, "h", "un " * 600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in truncate_subwords(df, cut, max_tokens=5, batch="lang").collect()}
    assert got[1].tokens == ["un", "##able", ",", "under", "##stand"] and got[1].mask == [1] * 5
    assert (got[2].tokens, got[2].ids, got[2].mask) == (["able"], [5], [1, 0, 0, 0, 0])
    assert got[3].mask == got[4].mask == [] and len(got[5].tokens) == 5
    alone = {r.doc_id: r.mask for r in truncate_subwords(df, cut, max_tokens=3).collect()}
    assert alone[2] == [1, 0, 0] and alone[3] == [0, 0, 0]


@pytest.mark.parametrize("limit", [1, 2, 4, 50])
def test_chunks_count_pieces_and_spell_the_text(spark, limit):
    cut = WordPieces.of(table(spark, VOCABULARY))
    texts = ["Unable, able. Understanding unable un. Zzz é!", "", "aBLe", "a b able"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", chunks("t", limit, cut.splitter()).alias("c")).collect():
        if not r.t:
            assert not r.c
            continue
        assert "".join(c.text for c in r.c).replace(" ", "") == r.t.replace(" ", "")
        assert max(c.n_tokens for c in r.c) <= limit
    sizes = df.select(F.size(F.flatten(cut.splitter().pieces(tx.sentence_pieces("t")))).alias("n")).collect()
    assert [s.n for s in sizes][0] == 2 + 1 + 1 + 1 + 3 + 2 + 1 + 1 + 1 + 1 + 1


def test_slices_of_texts_are_cut_like_the_whole():
    import pyarrow as pa

    cutter = WordPieces({"a": 1, "b": 2, "##a": 3, "##b": 4})
    rows = [None if i % 5 == 3 else [["ab", " ba"], [" abx"], []][: i % 4] for i in range(40)]
    texts = pa.array(rows, pa.list_(pa.list_(pa.string())))
    parts = pa.concat_arrays([cutter._spelled_lists(texts.slice(a, 8)) for a in range(0, 40, 8)])
    wanted = [["a", "b", " b", "a"], [" abx"], []]
    assert parts.to_pylist() == [None if r is None else wanted[: len(r)] for r in rows]
