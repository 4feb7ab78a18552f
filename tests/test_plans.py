"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from checks import standins as st
from checks.queries import QUERIES
from litvec.operators import chunking, embedding, passages, search
from litvec.plans import corpus

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_documents_become_chunks_without_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    nested = docs.select(
        F.col("doc_id").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.lit("2020").alias("date"),
        F.array("source").alias("authors"), F.col("lang").alias("journal"),
        F.array(F.struct(F.create_map(F.lit("type"), F.lit("abstract")).alias("infons"), "text")).alias("passages"),
    )
    for mode in ("section", "sentence"):
        text = plan(embedding.hash_embed(chunking.to_chunks(nested, mode), 64))
        assert "Exchange" not in text
    assert chunking.to_chunks(nested).count() > 0


def test_only_needed_columns_are_read(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    text = plan(search.knn(vectors, st.label_queries(spark, SF_DIR), id_col="vec_id", where="label = 3"))
    assert "ReadSchema: struct<vec_id:bigint,vector:" not in text  # the table names it embedding
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in text
    assert "WindowGroupLimit" in text


def test_reader_without_vectors_does_not_embed(spark):
    built = corpus.build_corpus(st.articles(spark, SF_DIR), corpus.hashing(64))
    assert "ArrowEvalPython" in plan(built) and "ArrowEvalPython" not in plan(built.select("id", "text"))


def test_vectors_are_computed_once_for_search(spark):
    built = corpus.build_corpus(st.articles(spark, SF_DIR), corpus.hashing(64))
    text = plan(search.knn(built, st.label_queries(spark, SF_DIR)))
    assert text.count("ArrowEvalPython") == 1


def test_corpus_in_document_order_or_as_it_lies(spark):
    docs = st.articles(spark, SF_DIR)
    ordered = corpus.build_corpus(docs, corpus.hashing(8)).select("id", "pos", "section", "chunk_no").orderBy("id").collect()
    assert [tuple(r)[1:] for r in ordered] == sorted(tuple(r)[1:] for r in ordered)
    lying = corpus.build_corpus(docs, corpus.hashing(8), position=None)
    assert sorted(r.id for r in lying.select("id").collect()) == list(range(len(ordered)))


def test_collapse_is_reduced_by_part(spark):
    turns = st.table(spark, SF_DIR, "conversations")
    text = plan(passages.collapse(turns, ("conv_id",), "role", "turn", "text"))
    assert "hashpartitioning(conv_id" in text and "_part" in text
