import json
import threading

import pytest
from pyspark.sql import functions as F

from litvec import runtime
from litvec.operators import passages
from litvec.plans import corpus
from litvec.sources import collections, documents, files, tables

DOC = {
    "pmid": "1", "pmcid": None, "date": "2020-01-02T00:00:00Z", "authors": ["A B", "C"], "journal": "J",
    "passages": [{"infons": {"type": "abstract"}, "text": "one two three four five six seven", "offset": 0}],
    "annotations": [],
}


@pytest.fixture
def folder(tmp_path):
    """Documents of the ids 123, 1234, 007 (two files) and a broken one."""
    (tmp_path / "deep").mkdir()
    for name, pmid in (("biocjson_123", "123"), ("biocjson_1234", "1234"), ("deep/biocjson_007", "007")):
        (tmp_path / f"{name}.json").write_text(json.dumps(DOC | {"pmid": pmid}, indent=4))
    (tmp_path / "biocjson_007.json").write_text(json.dumps(DOC | {"pmid": "007"}))
    (tmp_path / "biocjson_9.json").write_text('{"pmid": "9", "passages": [')
    (tmp_path / "df_123.csv").write_text("x")
    return tmp_path


def id_list(tmp_path, *lines):
    path = tmp_path / "ids.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_id_list_keeps_order_repeats_and_zeros(spark, tmp_path):
    listed = files.read_id_list(spark, id_list(tmp_path, "38", "007", "", "12,extra", "38"))
    assert [tuple(r) for r in listed.orderBy("pos").collect()] == [(0, "38"), (1, "007"), (2, "12"), (3, "38")]


def test_id_list_over_many_splits(spark, tmp_path):
    path = id_list(tmp_path, *[str(i * 7919 % 100_000) for i in range(100_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        listed = files.read_id_list(spark, path)
        wrong = listed.where(F.col("doc_id") != (F.col("pos") * 7919 % 100_000).cast("string"))
        assert listed.count() == 100_000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_selection(spark, folder):
    names = files.select_files(spark, str(folder), ["biocjson", "12"], exclude=["1234"])
    assert [r.name for r in names.collect()] == ["biocjson_123.json"]
    assert files.select_files(spark, str(folder)).count() == 6
    listing = spark.createDataFrame([("/x/a_1.json",), ("/a/b_2.json",)], "path string")
    assert [r.path for r in files.select_files(listing, identifiers=["a"]).collect()] == ["/x/a_1.json"]


@pytest.mark.parametrize("match, found", [("exact", {"123": 1, "007": 2}), ("substring", {"123": 2, "007": 2})])
def test_lookup(spark, folder, tmp_path, match, found):
    ids = files.read_id_list(spark, id_list(tmp_path, "123", "5", "007"))
    matches = files.matching_files(ids, files.select_files(spark, str(folder)), match)
    resolved = {r.doc_id: r for r in files.resolve_files(ids, matches).collect()}
    assert {k: r.n_files for k, r in resolved.items()} == found
    assert resolved["123"].path.endswith("/biocjson_123.json")
    assert [tuple(r) for r in files.missing_files(ids, matches).select("pos", "doc_id").collect()] == [(1, "5")]


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        files.matching_files(spark.range(1), spark.range(1), "fuzzy")


def test_documents_and_broken_files(spark, folder):
    read = documents.read_documents(spark, str(folder))
    assert sorted(r.pmid for r in read.collect()) == ["007", "007", "123", "1234"]
    assert read.count() == 4
    broken = documents.broken_files(spark, str(folder)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in broken] == ["biocjson_9.json"]
    flat = passages.flatten(read.where("pmid = '123'").drop("path")).first()
    assert flat.section == "abstract" and flat.authors == "A B and C"


def test_listed_documents_become_chunks_in_list_order(spark, folder, tmp_path):
    path = id_list(tmp_path, "1234", "5", "007", "1234")
    found, missing = corpus.documents_from_files(spark, path, str(folder))
    assert [r.doc_id for r in missing.collect()] == ["5"]
    built = corpus.build_corpus(found, corpus.hashing(16)).orderBy("id").collect()
    assert [(r.id, r.pmid) for r in built] == [(0, "1234"), (1, "007")]
    assert all(len(r.vector) == 16 for r in built)


def test_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"PubTator3": [DOC, DOC | {"pmid": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"PubTator3": []}))
    (tmp_path / "c.json").write_text(json.dumps({"detail": "no such id"}))
    (tmp_path / "d.json").write_text('{"PubTator3": [{"pmid": "3"')
    read = documents.read_responses(spark, str(tmp_path))
    assert [r.pmid for r in read.collect()] == ["1"] and read.count() == 1
    broken = documents.broken_files(spark, str(tmp_path), envelope="PubTator3")
    assert [r.path.rsplit("/", 1)[1] for r in broken.collect()] == ["d.json"]


def test_documents_written_as_json(spark, tmp_path, folder):
    read = documents.read_documents(spark, str(folder)).drop("path")
    documents.write_documents(read, str(tmp_path / "out"))
    again = documents.read_documents(spark, str(tmp_path / "out"), one_per_file=False).drop("path")
    assert sorted(again.collect()) == sorted(read.collect())


def test_embedding_text_with_unnamed_first_column(spark, tmp_path):
    path = tmp_path / "embeddings.tsv"
    path.write_text(
        "\tsection\tpmid\ttext\tembedding\n"
        '0\tabstract\t007\t"He said ""no""\tand left\nat once"\t"[0.5, -1e-3]"\n'
        "1\tintro\t12\tplain\t[1.0, 2.0]\n"
    )
    rows = tables.read_embeddings_tsv(spark, str(path)).orderBy("id").collect()
    assert rows[0].pmid == "007" and rows[0].text == 'He said "no"\tand left\nat once'
    assert [r.vector for r in rows] == [[0.5, pytest.approx(-1e-3)], [1.0, 2.0]]


def test_embedding_text_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "007", 'a "quoted"\ttext\n', [0.1, 1e-7]), (1, "1", "", [0.0, -2.5])],
        "id long, pmid string, text string, vector array<float>",
    )
    path = str(tmp_path / "e")
    tables.write_embeddings_tsv(df, path)
    again = tables.read_embeddings_tsv(spark, path).select(df.columns).orderBy("id").collect()
    assert [(r.id, r.pmid, r.text or "", r.vector) for r in again] == [tuple(r) for r in df.collect()]


def test_collection_lifecycle(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a", None), (1, [0.0, 1.0], None, 3)], "id long, vector array<float>, text string, n int")
    assert not collections.exists(spark, "papers", "c")
    with pytest.raises(LookupError):
        collections.open_collection(spark, "papers", "c")
    assert collections.write_collection(df, "papers", "c", 2, "ip") == 2
    assert collections.write_collection(df.limit(1), "papers", "c", 2, "ip") == 1
    assert collections.properties(spark, "papers", "c") == {"dimension": "2", "metric": "IP"}
    row = collections.open_collection(spark, "papers", "c").collect()
    assert [tuple(r) for r in row] == [(0, [1.0, 0.0], "a", "Unknown")]


def test_wrong_dimension_leaves_the_old_collection(spark):
    good = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vector array<float>")
    bad = spark.createDataFrame([(0, [1.0]), (1, None), (2, [1.0, 2.0])], "id long, vector array<float>")
    collections.write_collection(good, "papers", "kept", 2)
    assert sorted(r.id for r in collections.dimension_violations(bad, 2).collect()) == [0, 1]
    with pytest.raises(Exception, match="vector of dimension 2 expected"):
        collections.write_collection(bad, "papers", "kept", 2)
    assert collections.open_collection(spark, "papers", "kept").count() == 1
    with pytest.raises(ValueError):
        collections.write_collection(good, "papers", "kept", 2, "HAMMING")


def test_partitioned_collection(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "y")], "id long, vector array<float>, cell string")
    collections.write_collection(df, "papers", "cells", 1, partition_by=("cell",))
    found = collections.open_collection(spark, "papers", "cells").where("cell = 'y'")
    assert [r.id for r in found.collect()] == [1]
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString()


def test_shared_folder_comes_from_the_cluster(spark):
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_leaves_large_scans_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(16).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")
    try:
        many = spark.read.parquet(path)
        assert runtime.spread(many) is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert runtime.spread(spark.read.parquet(path).coalesce(1)).rdd.getNumPartitions() == 4


def test_collections_refuse_what_is_no_number(spark):
    for bad in ([1.0, None], [1.0, float("nan")], [float("inf"), 1.0]):
        df = spark.createDataFrame([(0, bad)], "id long, vector array<double>")
        assert collections.dimension_violations(df, 2).count() == 1
        with pytest.raises(Exception, match="vector with a null, a NaN or an infinity"):
            collections.write_collection(df, "papers", "bad", 2)


def numbers(spark, n):
    return spark.range(n).selectExpr("id", "array(1.0, 2.0) as vector")


def test_versions_switch_roll_back_and_stay_readable(spark):
    for n in (3, 5, 7):
        collections.write_collection(numbers(spark, n), "papers", "swapped", 2, keep=3)
    assert collections.versions(spark, "papers", "swapped") == [1, 2, 3]
    pinned = collections.open_collection(spark, "papers", "swapped")
    entries = collections.manifest(spark, "papers", "swapped")
    assert [(e["version"], e["rows"], e["current"]) for e in entries] == [(1, "3", False), (2, "5", False), (3, "7", True)]
    collections.switch(spark, "papers", "swapped", 1)
    assert collections.open_collection(spark, "papers", "swapped").count() == 3 and pinned.count() == 7
    assert spark.table("papers.swapped").count() == 3
    assert collections.open_collection(spark, "papers", "swapped", version=2).count() == 5
    collections.write_collection(numbers(spark, 9), "papers", "swapped", 2, keep=1)
    assert collections.versions(spark, "papers", "swapped") == [4] == [collections.current_version(spark, "papers", "swapped")]
    for wrong in (lambda: collections.switch(spark, "papers", "swapped", 2), lambda: collections.open_collection(spark, "papers", "swapped", 2)):
        with pytest.raises(LookupError):
            wrong()
    with pytest.raises(ValueError):
        collections.drop_versions(spark, "papers", "swapped", 0)


def test_a_failed_write_leaves_no_version(spark):
    collections.write_collection(numbers(spark, 2), "papers", "held", 2)
    with pytest.raises(Exception, match="vector of dimension 3 expected"):
        collections.write_collection(numbers(spark, 2), "papers", "held", 3)
    assert collections.versions(spark, "papers", "held") == [1] and collections.open_collection(spark, "papers", "held").count() == 2


def test_readers_never_miss_a_collection_that_is_swapped(spark):
    collections.write_collection(numbers(spark, 1), "papers", "busy", 2)
    seen, failed, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.append(collections.open_collection(spark, "papers", "busy").count())
            except Exception as error:  # reported by the test
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(2, 22):
            collections.write_collection(numbers(spark, n), "papers", "busy", 2, keep=4)
    finally:
        done.set()
        reader.join()
    assert not failed, failed[0]
    assert seen == sorted(seen) and set(seen) <= set(range(1, 22))


def test_run_folder_is_dropped(spark):
    with runtime.run_folder(spark) as path:
        staged = runtime.stage(spark.range(5))
        assert staged.count() == 5 and runtime.bytes_under(spark, path) > 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_tables_of_one_line_per_row_are_split(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [(i, f'a "quoted"\tcell\r\nof 100 % and %0A, number {i}' if i % 3 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    tables.write_table(df, path, "tsv", one_line=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = tables.read_tsv(spark, path, one_line=True)
        assert found.rdd.getNumPartitions() > 3
        assert sorted((int(r.id), r.text) for r in found.collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
