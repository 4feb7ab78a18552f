import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from litvec.operators import chunking, dedupe, ids, passages
from litvec.sources.documents import DOCUMENT


def passage(text, section=None, kind=None):
    return {"infons": {"section_type": section, "type": kind}, "text": text}


LONG = "one two three four five six"


def documents(spark):
    rows = [
        ("1", "PMC1", "2020-01-02", ["A", None, "B"], "J", [
            passage("A title", " TITLE"),
            passage(LONG, " Abstract "),
            passage(f" {LONG} seven!\t", "ABSTRACT"),
            passage("too few words here now", "ABSTRACT"),
            passage(LONG + "?", "results"),
            passage(LONG, None),
        ]),
        ("2", None, "bad date", [], "J", [passage(LONG, "RESULTS", "abstract"), passage(LONG, None, "ref")]),
        ("3", None, "2020-01-02", ["C"], None, []),
        ("4", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


def test_flatten(spark):
    rows = passages.flatten(documents(spark)).orderBy("pmid", "index").collect()
    assert [(r.pmid, r["index"], r.section) for r in rows] == [
        ("1", 0, " TITLE"), ("1", 1, " Abstract "), ("1", 2, "ABSTRACT"), ("1", 3, "ABSTRACT"),
        ("1", 4, "results"), ("1", 5, None), ("2", 0, "abstract"), ("2", 1, "ref"),
    ]
    assert rows[0].authors == "A and B" and rows[0].pmcid == "PMC1" and rows[6].authors == ""


def test_missing_infon_gives_null_section(spark):
    row = ("1", None, None, [], None, [{"infons": {}, "text": "x"}, {"infons": None, "text": "y"}])
    rows = passages.flatten(spark.createDataFrame([row], DOCUMENT)).collect()
    assert [r.section for r in rows] == [None, None]


def test_clean_and_filters(spark):
    cleaned = passages.clean(passages.flatten(documents(spark)))
    kept = passages.min_words(passages.keep_sections(cleaned)).orderBy("pmid", "index").collect()
    assert [(r.pmid, r["index"], r.section, r.sentence) for r in kept] == [
        ("1", 1, "abstract", LONG + "."),
        ("1", 2, "abstract", LONG + " seven!"),
        ("1", 4, "results", LONG + "?"),
        ("2", 0, "abstract", LONG + "."),
    ]
    assert str(kept[0].date) == "2020-01-02 00:00:00" and kept[3].date is None
    titles = passages.keep_sections(cleaned, passages.TITLE_SECTIONS).where("section = 'title'").collect()
    assert [r.sentence for r in titles] == ["A title."]


def test_section_chunks_equal_the_grouped_form(spark):
    docs = documents(spark)
    cleaned = passages.clean(passages.flatten(docs))
    grouped = passages.collapse(passages.min_words(passages.keep_sections(cleaned)))
    columns = ["pmid", "section", "text", "pmcid", "date", "authors", "journal"]
    by_row = chunking.section_texts(docs).select(columns).orderBy("pmid", "section").collect()
    assert by_row == grouped.select(columns).orderBy("pmid", "section").collect()
    assert [(r.pmid, r.section) for r in by_row] == [("1", "abstract"), ("1", "results"), ("2", "abstract")]


def test_sentence_mode(spark):
    rows = chunking.to_chunks(documents(spark), "sentence").orderBy("pmid", "chunk_no").collect()
    assert [(r.pmid, r.chunk_no, r.text, r.n_tokens) for r in rows] == [
        ("1", 1, LONG, 6), ("1", 2, LONG + " seven!", 8), ("1", 4, LONG + "?", 7), ("2", 0, LONG, 6),
    ]
    with pytest.raises(ValueError):
        chunking.to_chunks(documents(spark), "page")


def test_documents_without_chunks(spark):
    docs = documents(spark)
    dropped = passages.dropped_documents(docs, chunking.to_chunks(docs))
    assert sorted(r.pmid for r in dropped.collect()) == ["3", "4"]


def test_empty_input_gives_empty_chunks(spark):
    docs = documents(spark).where("pmid = 'none'")
    assert chunking.to_chunks(docs).count() == 0 and chunking.to_chunks(docs, "sentence").count() == 0


def test_collapse_sorts_and_joins_the_parts_of_long_groups(spark):
    rows = [(1, "b", i, f"s{i}", "m" if i == 2 else "x") for i in (7, 2, 5, 3, 11)] + [(1, None, 9, "no", "x")]
    df = spark.createDataFrame(rows, "pmid int, section string, index long, sentence string, meta string")
    whole = passages.collapse(df).collect()
    assert whole == [Row(pmid=1, section="b", text="s2 s3 s5 s7 s11", n_passages=5, meta="m")]
    assert passages.collapse(df, part_size=4).collect() == whole
    gaps = spark.createDataFrame([(1, "b", i, None if i < 8 else f"s{i}", "m") for i in range(12)], df.schema)
    assert [r.text for r in passages.collapse(gaps, part_size=4).collect()] == ["s8 s9 s10 s11"]


def test_dedupe_keeps_the_first_of_each_text(spark):
    rows = [(3, "a", "x"), (1, "a", "x"), (2, "a", "y"), (4, None, "x"), (5, None, "x"), (6, "", "x")]
    df = spark.createDataFrame(rows, "i long, text string, section string")
    assert sorted(r.i for r in dedupe.dedupe_text(df, "i", "text", "section").collect()) == [1, 2, 4, 6]


def test_latest_per_id(spark):
    rows = [("a", 0, "old"), ("b", 1, "only"), ("a", 2, None), ("c", 3, "x")]
    df = spark.createDataFrame(rows, "doc_id string, pos long, value string")
    found = dedupe.latest_per_id(df, "doc_id", "pos").orderBy("pos").collect()
    assert [tuple(r) for r in found] == [("a", 0, None), ("b", 1, "only"), ("c", 3, "x")]


def test_single_id_violations(spark):
    df = spark.createDataFrame([("f", "1"), ("f", "1"), ("g", "1"), ("g", "2")], "frame string, pmid string")
    assert [r.frame for r in passages.single_id_violations(df, "frame", "pmid").collect()] == ["g"]


def test_fill_unknown(spark):
    df = spark.createDataFrame([(1, None, None, [1.0]), (None, "x", 2.5, None)], "id int, a string, b double, v array<double>")
    filled = passages.fill_unknown(df, skip=("id",)).orderBy("a")
    assert [tuple(r) for r in filled.collect()] == [(1, "Unknown", "Unknown", [1.0]), (None, "x", "2.5", None)]


def test_union_of_different_columns(spark):
    one = spark.createDataFrame([(1, "a")], "id int, a string")
    two = spark.createDataFrame([(2, "b")], "id int, b string")
    assert [tuple(r) for r in passages.union_sources(one, two).orderBy("id").collect()] == [(1, "a", None), (2, None, "b")]


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"), F.lit("hot").alias("doc"))
    rows = ids.dense_ids(df, "doc", F.col("key").desc()).collect()
    assert sorted((r.id, r.key) for r in rows) == [(i, 999 - i) for i in range(1000)]
    unordered = ids.dense_ids(spark.range(100).withColumnRenamed("id", "x")).collect()
    assert sorted(r.id for r in unordered) == list(range(100))
    assert all(r.id == r.x for r in unordered)
    assert ids.dense_ids(df.where("key < 0"), "key").count() == 0


def test_labels_there_and_back(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, None)], "i int, label string")
    coded = ids.encode_labels(df, "label").orderBy("i").collect()
    assert [r.code for r in coded] == [1, 0, 2, 0, None]
    codes = ids.label_codes(df, "label")
    back = ids.decode_labels(spark.createDataFrame([(1, 2), (2, 0)], "i int, code long"), codes).orderBy("i")
    assert [r.label for r in back.collect()] == ["c", "a"]


def test_chunk_quality(spark):
    df = spark.createDataFrame([(1, "a b c. d e f g h i j k.")], "doc int, text string")
    assert [tuple(r) for r in chunking.chunk_quality(df, 5).collect()] == [(1, 13, 3, 13, 0, 0)]
    with pytest.raises(ValueError):
        chunking.chunk_texts(df, 0)


def test_empty_texts_give_no_chunk(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "x")], "doc int, text string")
    assert [r.doc for r in chunking.chunk_texts(df, 5).collect()] == [4]


def test_first_n(spark):
    assert [r.id for r in passages.first_n(spark.range(50).orderBy(F.rand(1)), 3, "id").collect()] == [0, 1, 2]
