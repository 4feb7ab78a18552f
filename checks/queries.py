"""One query per operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as st
from litvec.functions import packing, vector
from litvec.functions.nearest import unit
from litvec.functions.subwords import WordPieces
from litvec.functions import text as tx
from litvec.functions import treebank as tb
from litvec.operators import (
    blocks,
    chunking,
    dedupe,
    embedding,
    hashing,
    ids,
    layout,
    passages,
    pooling,
    projection,
    prompts,
    pruned,
    quantized,
    search,
    sentences,
)
from litvec.plans import corpus, retrieval
from litvec.runtime import stage, staging_path
from litvec.sources import collections, documents, files, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = st.DIM


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _cells(df: DataFrame, key: str, values: str) -> DataFrame:
    """Vectors as one row per dimension. The outer form, as the other one would filter by a lazy vector first."""
    return df.select(key, F.posexplode_outer(values).alias("dim", "value")).select(
        key, F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


# --- sources and sinks ---


@query
def id_list_scan(spark, sf_dir):
    path = staging_path(spark, "id-list")
    st.table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").write.csv(path)
    return files.read_id_list(spark, path)


def _listing(spark, sf_dir):
    """A file per vector and per page: numbers with two files, one, or none."""
    one = st.table(spark, sf_dir, "embeddings").select(F.format_string("/a/biocjson_%d.json", "vec_id").alias("path"))
    two = st.table(spark, sf_dir, "pages").select(F.format_string("/b/biocjson_%d.json", "page_id").alias("path"))
    return files.select_files(one.union(two), identifiers=["biocjson", ".json"], exclude=["tmp"])


def _wanted(spark, sf_dir):
    labels = st.table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("doc_id"))


@query
def file_lookup(spark, sf_dir):
    wanted = _wanted(spark, sf_dir)
    return files.resolve_files(wanted, files.matching_files(wanted, _listing(spark, sf_dir)))


@query
def file_lookup_substring(spark, sf_dir):
    wanted = _wanted(spark, sf_dir)
    return files.resolve_files(wanted, files.matching_files(wanted, _listing(spark, sf_dir), "substring"))


@query
def file_missing(spark, sf_dir):
    wanted = _wanted(spark, sf_dir)
    return files.missing_files(wanted, files.matching_files(wanted, _listing(spark, sf_dir))).select("pos", "doc_id")


@query
def document_json_roundtrip(spark, sf_dir):
    path = staging_path(spark, "documents-json")
    documents.write_documents(st.articles(spark, sf_dir), path)
    read = documents.read_documents(spark, path, one_per_file=False).drop("path")
    return passages.flatten(read)


@query
def envelope_unwrap(spark, sf_dir):
    path = staging_path(spark, "responses-json")
    fields = [f.name for f in documents.DOCUMENT.fields]
    wrapped = st.articles(spark, sf_dir).select(F.array(F.struct(*fields)).alias(documents.ENVELOPE))
    wrapped.write.json(path)
    read = documents.read_responses(spark, path, one_per_file=False)
    return read.select("pmid", "pmcid", "journal", F.size("passages").cast("long").alias("n_passages"))


@query
def passage_table_roundtrip(spark, sf_dir):
    path = staging_path(spark, "passages")
    flat = passages.flatten(st.articles(spark, sf_dir)).drop("pos")
    tables.write_table(tables.with_bucket(flat, "pmid", 8), path, partition_by=("doc_bucket",))
    return spark.read.parquet(path).drop("doc_bucket")


@query
def embedding_tsv_roundtrip(spark, sf_dir):
    path = staging_path(spark, "embeddings-tsv")
    tables.write_embeddings_tsv(st.vectors(spark, sf_dir), path)
    return _cells(tables.read_embeddings_tsv(spark, path), "id", "vector")


@query
def chunk_tsv_roundtrip(spark, sf_dir):
    path = staging_path(spark, "chunks-tsv")
    chunks = chunking.to_chunks(st.articles(spark, sf_dir))
    tables.write_table(chunks.select("pmid", "section", "chunk_no", "text", "pmcid"), path, "tsv")
    return tables.read_tsv(spark, path)


@query
def collection_roundtrip(spark, sf_dir):
    namespace = "checks_" + uuid.uuid4().hex
    collections.ensure_namespace(spark, namespace, staging_path(spark, "collections"))
    collections.write_collection(st.vectors(spark, sf_dir), namespace, "vectors", DIM)
    return _cells(collections.open_collection(spark, namespace, "vectors"), "id", "vector")


@query
def dimension_check(spark, sf_dir):
    corpus_vectors = st.vectors(spark, sf_dir)
    right, wrong = (collections.dimension_violations(corpus_vectors, d).agg(F.count("*").alias("n")) for d in (DIM, 32))
    return right.select(F.lit(DIM).cast("long").alias("dim"), "n").union(
        wrong.select(F.lit(32).cast("long").alias("dim"), "n")
    )


# --- passages ---


@query
def passages_flatten(spark, sf_dir):
    return passages.flatten(st.articles(spark, sf_dir)).drop("pos")


@query
def section_choice(spark, sf_dir):
    flat = passages.flatten(st.articles(spark, sf_dir))
    return flat.select("pmid", "index", "section", tx.normalise_section("section").alias("normal"))


@query
def passages_clean(spark, sf_dir):
    kept = passages.min_words(passages.clean(passages.flatten(st.articles(spark, sf_dir))))
    return kept.select("pmid", "index", "section", "sentence", F.unix_micros("date").alias("date_us"))


@query
def keep_sections_default(spark, sf_dir):
    kept = passages.keep_sections(passages.clean(passages.flatten(st.articles(spark, sf_dir))))
    return kept.select("pmid", "index", "section")


@query
def keep_sections_title(spark, sf_dir):
    cleaned = passages.clean(passages.flatten(st.articles(spark, sf_dir)))
    return passages.keep_sections(cleaned, passages.TITLE_SECTIONS).select("pmid", "index", "section")


@query
def date_parse(spark, sf_dir):
    events = st.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.unix_micros(tx.parse_date(F.col("ts").cast("string"), strict=True)).alias("ts_us"),
        F.unix_micros(tx.parse_date("event_type")).alias("bad_us"),
    )


@query
def authors_join(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    named = F.array("source", F.when(F.col("lang") == "en", F.col("lang")), F.lit("et al"))
    return docs.select("doc_id", tx.joined_authors(named).alias("authors"))


@query
def fill_unknown(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    partly = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("source")).alias("source"),
        F.when(F.col("lang") != "en", F.col("n_chars")).alias("n_chars"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return passages.fill_unknown(partly, skip=("doc_id",))


@query
def dropped_documents(spark, sf_dir):
    docs = st.articles(spark, sf_dir)
    return passages.dropped_documents(docs.select("pmid", "journal"), chunking.to_chunks(docs))


@query
def documents_without_chunks(spark, sf_dir):
    return chunking.without_chunks(st.articles(spark, sf_dir)).select("pmid", "journal")


@query
def first_n_docs(spark, sf_dir):
    return passages.first_n(st.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 15, "doc_id")


@query
def collapse_conversation(spark, sf_dir):
    turns = st.table(spark, sf_dir, "conversations")
    return passages.collapse(turns, ("conv_id",), "role", "turn", "text").withColumnRenamed("text", "joined")


@query
def collapse_documents(spark, sf_dir):
    cleaned = passages.clean(passages.flatten(st.articles(spark, sf_dir)).drop("pos"))
    collapsed = passages.collapse(passages.min_words(passages.keep_sections(cleaned)))
    return collapsed.withColumn("date_us", F.unix_micros("date")).drop("date")


@query
def section_texts(spark, sf_dir):
    texts = chunking.section_texts(st.articles(spark, sf_dir))
    return texts.withColumn("date_us", F.unix_micros("date")).drop("date", "pos")


@query
def dedupe_text(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    return dedupe.dedupe_text(docs, "doc_id", "text", "lang").select("doc_id", "lang", "source", "n_chars")


@query
def dedupe_text_ties(spark, sf_dir):
    """An order with nulls and many ties: which row stays is open, its order is not."""
    order = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 3)
    docs = st.table(spark, sf_dir, "documents").withColumn("place", order)
    kept = dedupe.dedupe_text(docs.union(docs), "place", "text", "lang")
    return kept.select(F.sha2("text", 256).alias("digest"), "lang", "place")


@query
def latest_per_id(spark, sf_dir):
    orders = st.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_totalprice"
    )
    return dedupe.latest_per_id(orders, "doc_id", "pos")


@query
def single_id_check(spark, sf_dir):
    return passages.single_id_violations(st.table(spark, sf_dir, "documents"), "source", "lang")


@query
def chunk_counts(spark, sf_dir):
    return passages.counts(chunking.to_chunks(st.articles(spark, sf_dir)), "pmid", "section")


@query
def label_encode(spark, sf_dir):
    return ids.encode_labels(st.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query
def label_decode(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "source")
    codes = stage(ids.label_codes(docs, "source"), "codes")
    return ids.decode_labels(docs.join(codes, "source").select("doc_id", "code"), codes)


@query
def union_sources(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    english = docs.where(F.col("lang") == "en").select("doc_id", "lang", "n_chars")
    other = docs.where(F.col("lang") != "en").select("doc_id", "source", "lang")
    return passages.union_sources(english, other)


@query
def dense_ids(spark, sf_dir):
    turns = st.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ids.dense_ids(turns, "conv_id", "turn")


# --- chunks ---


@query
def sentence_tokens(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    split = docs.select("doc_id", F.posexplode(tx.sentences("text")).alias("sentence_no", "sentence"))
    return split.select(
        "doc_id",
        F.col("sentence_no").cast("long").alias("sentence_no"),
        "sentence",
        F.array_join(tx.tokens("sentence"), "|").alias("tokens"),
    )


def _packed(spark, sf_dir, max_tokens):
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_texts(docs, max_tokens).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def pack_100(spark, sf_dir):
    return _packed(spark, sf_dir, chunking.DEMO_MAX_TOKENS)


@query
def pack_guarded(spark, sf_dir):
    """Texts that are null, empty or blank give no chunk."""
    blank = F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, " \t\n").when(F.col("doc_id") % 4 == 3, F.col("text"))
    docs = st.table(spark, sf_dir, "documents").select("doc_id", blank.alias("text"))
    return chunking.chunk_texts(docs).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def pack_350(spark, sf_dir):
    return _packed(spark, sf_dir, chunking.NOTEBOOK_MAX_TOKENS)


@query
def fixed_slices(spark, sf_dir):
    sliced = st.vectors(spark, sf_dir).select("id", F.posexplode(packing.fixed_slices("vector", 10)).alias("no", "s"))
    return sliced.select(
        "id",
        F.col("no").cast("long").alias("slice_no"),
        F.size("s").cast("long").alias("n"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def _chunk_columns(chunks):
    return chunks.select("pmid", "section", "chunk_no", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def chunk_text_section(spark, sf_dir):
    return _chunk_columns(chunking.to_chunks(st.articles(spark, sf_dir), "section"))


@query
def chunk_text_sentence(spark, sf_dir):
    return _chunk_columns(chunking.to_chunks(st.articles(spark, sf_dir), "sentence"))


@query
def chunk_quality(spark, sf_dir):
    return chunking.chunk_quality(st.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sentence_model(spark, sf_dir):
    return stage(sentences.learn(st.table(spark, sf_dir, "documents")), "sentence-model")


@query
def sentence_model(spark, sf_dir):
    """Abbreviations, starters and words behind ordinals of all documents."""
    return _sentence_model(spark, sf_dir).withColumn("score", F.round("score", 4))


@query
def sentences_learned(spark, sf_dir):
    model = sentences.SentenceModel.of(_sentence_model(spark, sf_dir))
    return sentences.split_sentences(st.table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def _sentences(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    split = docs.select("doc_id", F.posexplode(tx.sentences("text")).alias("no", "sentence"))
    return split.select("doc_id", F.col("no").cast("long").alias("sentence_no"), "sentence")


@query
def treebank_tokens(spark, sf_dir):
    tokens = tb.treebank_tokens("sentence")
    return _sentences(spark, sf_dir).select("doc_id", "sentence_no", F.array_join(tokens, "|").alias("tokens"))


@query
def detokenize(spark, sf_dir):
    """The sentence from its pieces, exactly, and from bare tokens, as print is spaced."""
    both = _sentences(spark, sf_dir).select(
        "doc_id",
        "sentence_no",
        tb.spelled(tb.treebank_pieces("sentence")).alias("spelled"),
        tb.detokenize(tb.treebank_tokens("sentence")).alias("printed"),
    )
    return both


@query
def pack_treebank(spark, sf_dir):
    """Chunks that count treebank tokens: how many, their tokens, and what they hold."""
    splitter = packing.Splitter(pieces=lambda s: F.transform(s, tb.treebank_pieces))
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.chunk_texts(docs, chunking.DEMO_MAX_TOKENS, splitter)
    return chunks.select("doc_id", "chunk_no", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


def _word_pieces(spark, sf_dir):
    """A vocabulary that both sides can make: the words of the questions and all their letters, to start and to go on with."""
    words = st.questions(spark, sf_dir).select(F.explode(tx.tokens(F.lower("text"))).alias("piece")).distinct()
    letters = words.select(F.explode(F.split("piece", "")).alias("piece")).where("piece <> ''")
    starts = words.union(letters).distinct()
    marked = starts.union(starts.select(F.concat(F.lit("##"), "piece")))
    return WordPieces.of(marked.select("piece", F.crc32("piece").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("id")))


@query
def truncate_subwords(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    masked = embedding.truncate_subwords(docs, _word_pieces(spark, sf_dir), batch="lang")
    return masked.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_pieces"),
        F.size("mask").cast("long").alias("n_mask"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ones"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query
def pack_subwords(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.chunk_texts(docs, chunking.DEMO_MAX_TOKENS, _word_pieces(spark, sf_dir).splitter())
    return chunks.select("doc_id", "chunk_no", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


# --- vectors ---


@query
def truncate_mask(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    masked = embedding.truncate_mask(docs, batch="lang")
    return masked.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size("mask").cast("long").alias("n_mask"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ones"),
    )


@query
def truncate_mask_gaps(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"),
    )
    masked = embedding.truncate_mask(docs, batch="lang")
    return masked.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size("mask").cast("long").alias("n_mask"))


@query
def hash_embed(spark, sf_dir):
    return _cells(embedding.hash_embed(st.questions(spark, sf_dir), DIM), "query_id", "vector")


def _length_model():
    """A stand-in model: a token is the vector (its length, 1), short texts are padded and masked."""

    def encode(texts: list[str]):
        words = [t.split(" ") for t in texts]
        longest = max(map(len, words))
        vectors = np.zeros((len(texts), longest, 2))
        mask = np.zeros((len(texts), longest))
        for row, text in enumerate(words):
            vectors[row, : len(text), 0] = [len(w) for w in text]
            vectors[row, : len(text), 1] = 1
            mask[row, : len(text)] = 1
        return vectors, mask

    return encode


@query
def embed_model(spark, sf_dir):
    lines = passages.flatten(st.articles(spark, sf_dir)).select(
        F.concat_ws("-", "pmid", "index").alias("key"), F.col("sentence").alias("text")
    )
    return _cells(embedding.embed(lines, _length_model, pooling="mean_pooling"), "key", "vector")


def _pooled(spark, sf_dir, name):
    return _cells(pooling.pool(st.token_vectors(spark, sf_dir), "label", pooling=name), "label", "vec")


@query
def mean_pool(spark, sf_dir):
    return _pooled(spark, sf_dir, "mean_pooling")


@query
def attention_pool(spark, sf_dir):
    return _pooled(spark, sf_dir, "attention_pooling")


@query
def attention_pool_scores(spark, sf_dir):
    """Scores from far below zero to several hundred in place of a mask."""
    scored = st.token_vectors(spark, sf_dir).withColumn("mask", F.col("vec")[1].cast("double") * 2000 - 500)
    return _cells(pooling.pool(scored, "label", pooling="attention_pooling"), "label", "vec")


@query
def l2_normalize(spark, sf_dir):
    scaled = st.vectors(spark, sf_dir).select(
        "id", F.transform("vector", lambda x: x.cast("double") * (F.col("label") + 2)).alias("vector")
    )
    return _cells(scaled.select("id", vector.l2_normalize("vector").alias("vector")), "id", "vector")


@query
def vector_text_roundtrip(spark, sf_dir):
    texts = st.vectors(spark, sf_dir).select("id", F.to_json("vector").alias("text"))
    return _cells(texts.select("id", vector.parse_vector("text").cast("array<float>").alias("vector")), "id", "vector")


@query
def vector_shape(spark, sf_dir):
    return projection.vector_shape(st.vectors(spark, sf_dir))


@query
def pca_2d(spark, sf_dir):
    """What does not depend on the sign of an axis: the variance along each, and the rows of each label and code."""
    points = projection.project_2d(st.vectors(spark, sf_dir), "id", "label")
    spread_of = points.agg(F.var_samp("x").alias("x"), F.var_samp("y").alias("y"))
    axes = spread_of.select(F.explode(F.create_map(F.lit("x"), F.col("x"), F.lit("y"), F.col("y"))).alias("name", "value"))
    coded = points.groupBy("label", "code").agg(F.count("*").cast("double").alias("value"))
    named = coded.select(F.format_string("label %d is %d", "label", "code").alias("name"), "value")
    return axes.union(named).withColumn("value", F.round("value", 8))


@query
def neighbour_graph(spark, sf_dir):
    """Which points pull each other."""
    return layout.neighbour_graph(st.vectors(spark, sf_dir), neighbours=5).select("a", "b")


@query
def neighbour_layout(spark, sf_dir):
    return layout.neighbour_layout(st.vectors(spark, sf_dir))


# --- search ---


def _hits(spark, sf_dir, metric, where=None):
    hits = search.knn(st.vectors(spark, sf_dir), st.label_queries(spark, sf_dir), metric=metric, where=where)
    return hits.withColumn("score", F.round("score", 9))


@query
def knn_cosine(spark, sf_dir):
    return _hits(spark, sf_dir, "COSINE")


@query
def knn_ip(spark, sf_dir):
    return _hits(spark, sf_dir, "IP")


@query
def knn_l2(spark, sf_dir):
    return _hits(spark, sf_dir, "L2")


@query
def knn_with_gaps(spark, sf_dir):
    """Vectors that are null or hold a NaN or a null, and a question with a NaN, beside good ones."""
    gaps = st.vectors(spark, sf_dir).withColumn(
        "vector",
        F.when(F.col("id") % 5 == 1, None)
        .when(F.col("id") % 5 == 2, F.transform("vector", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x)))
        .when(F.col("id") % 5 == 3, F.transform("vector", lambda x, i: F.when(i != 3, x)))
        .otherwise(F.col("vector")),
    )
    queries = st.label_queries(spark, sf_dir)
    bad = queries.select((-1 - F.col("query_id")).alias("query_id"), F.transform("vector", lambda x: x * float("nan")).alias("vector"))
    return search.knn(gaps, queries.union(bad))


@query
def knn_ip_small(spark, sf_dir):
    """Products far below any fixed rounding step."""
    small = st.vectors(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * 1e-12))
    return search.knn(small, st.label_queries(spark, sf_dir), metric="IP").drop("score")


@query
def knn_filtered(spark, sf_dir):
    return _hits(spark, sf_dir, "COSINE", "label = 3")


@query
def knn_fields(spark, sf_dir):
    hits = search.knn(
        st.vector_collection(spark, sf_dir), st.label_queries(spark, sf_dir), fields=retrieval.HIT_FIELDS
    )
    return search.entities(hits)


def _in_cells(spark, sf_dir, probes):
    corpus_vectors = st.vectors(spark, sf_dir)
    centroids = search.fit_cells(corpus_vectors, 16)
    celled = stage(search.assign_cells(corpus_vectors, centroids), "cells")
    return search.knn_cells(celled, st.label_queries(spark, sf_dir), centroids, probes)


@query
def knn_cells_all(spark, sf_dir):
    """Every cell probed: the exact result."""
    return _in_cells(spark, sf_dir, 16)


@query
def knn_cells_recall(spark, sf_dir):
    """Cells around the means of the labels, of which four are probed."""
    queries = stage(st.label_queries(spark, sf_dir), "queries")
    centroids = unit(np.array([r.vector for r in queries.orderBy("query_id").collect()]))
    cells = search.assign_cells(st.vectors(spark, sf_dir), centroids)
    return search.recall(search.knn_cells(cells, queries, centroids, 4), search.knn(st.vectors(spark, sf_dir), queries))


@query
def knn_many_questions(spark, sf_dir):
    """Every vector is a question; small blocks, so that there are several."""
    vectors = st.vectors(spark, sf_dir)
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    return search.knn(vectors, queries, k=5, block_bytes=64 << 10)


@query
def knn_joined(spark, sf_dir):
    """Every vector is a question, and both sides are cut into small blocks."""
    vectors = st.vectors(spark, sf_dir)
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    return blocks.knn_joined(vectors, queries, k=5, block_bytes=64 << 10)


def _some_questions(spark, sf_dir):
    """Every twentieth vector is a question."""
    return st.vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query
def knn_hashed(spark, sf_dir):
    return hashing.knn_hashed(st.vectors(spark, sf_dir), _some_questions(spark, sf_dir))


@query
def knn_hashed_recall(spark, sf_dir):
    corpus_vectors, queries = st.vectors(spark, sf_dir), _some_questions(spark, sf_dir)
    return search.recall(hashing.knn_hashed(corpus_vectors, queries), search.knn(corpus_vectors, queries))


def _pruned(spark, sf_dir, metric):
    corpus_vectors = st.vectors(spark, sf_dir)
    centroids = search.fit_cells(corpus_vectors, 16, metric=metric)
    celled = stage(search.assign_cells(corpus_vectors, centroids, metric=metric), "cells")
    bounds = stage(pruned.cell_bounds(celled, centroids, metric), "cell-bounds")
    hits = pruned.knn_pruned(celled, st.label_queries(spark, sf_dir), centroids, bounds, metric=metric)
    return hits.withColumn("score", F.round("score", 9))


@query
def knn_pruned_cosine(spark, sf_dir):
    return _pruned(spark, sf_dir, "COSINE")


@query
def knn_pruned_ip(spark, sf_dir):
    return _pruned(spark, sf_dir, "IP")


@query
def knn_pruned_l2(spark, sf_dir):
    return _pruned(spark, sf_dir, "L2")


@query
def knn_quantized(spark, sf_dir):
    """A byte for each of eight parts; the best by codes are scored exactly. The parts of 64 vectors are the code vectors."""
    corpus_vectors = st.vectors(spark, sf_dir)
    first = corpus_vectors.where("id < 64").orderBy("id").collect()
    books = np.array_split(unit(np.array([r.vector for r in first], dtype=np.float64)), 8, axis=1)
    compressed = stage(quantized.compress(corpus_vectors, books), "codes")
    hits = quantized.knn_quantized(corpus_vectors, compressed, st.label_queries(spark, sf_dir), books)
    return hits.withColumn("score", F.round("score", 9))


@query
def knn_filtered_cells(spark, sf_dir):
    """Cells around the means of the labels; a filter that leaves few rows in each."""
    queries = stage(st.label_queries(spark, sf_dir), "queries")
    centroids = unit(np.array([r.vector for r in queries.orderBy("query_id").collect()]))
    cells = stage(search.assign_cells(st.vectors(spark, sf_dir), centroids), "cells")
    return pruned.knn_filtered_cells(cells, queries, centroids, 1, where="id % 7 = 3")


@query
def collection_search(spark, sf_dir):
    """A stored collection is searched by its own metric."""
    namespace = "checks_" + uuid.uuid4().hex
    collections.ensure_namespace(spark, namespace, staging_path(spark, "collections"))
    scaled = st.vectors(spark, sf_dir).withColumn(
        "vector", F.transform("vector", lambda x: x.cast("double") * (F.col("label") + 1))
    )
    collections.write_collection(scaled, namespace, "scaled", DIM, "IP")
    found = retrieval.search_collection(
        spark, namespace, "scaled", st.label_queries(spark, sf_dir), lambda df: df, where="label <> '4'", fields=("label",)
    )
    return found.select("query_id", "rank", "id", F.round("score", 9).alias("score"), "entity.label")


# --- prompts ---


@query
def rag_from_collection(spark, sf_dir):
    """Documents to sentences, to a stored collection, to prompts."""
    namespace = "checks_" + uuid.uuid4().hex
    collections.ensure_namespace(spark, namespace, staging_path(spark, "collections"))
    embedder = corpus.hashing(DIM)
    corpus.store_corpus(st.articles(spark, sf_dir), embedder, namespace, "sentences", DIM, mode="sentence")
    built = retrieval.prompt_from_collection(spark, namespace, "sentences", st.questions(spark, sf_dir), embedder, k=5)
    return prompts.message_columns(built)


def _label_prompts(spark, sf_dir, build):
    queries = stage(st.label_queries(spark, sf_dir), "queries")
    hits = search.knn(st.vector_collection(spark, sf_dir), queries, fields=retrieval.HIT_FIELDS)
    texts = queries.select("query_id", F.format_string("What is label %d about?", "query_id").alias("text"))
    return prompts.message_columns(build(texts, hits))


@query
def prompt_default(spark, sf_dir):
    return _label_prompts(spark, sf_dir, prompts.messages)


@query
def prompt_tagged(spark, sf_dir):
    return _label_prompts(spark, sf_dir, prompts.tagged)


@query
def prompt_gaps(spark, sf_dir):
    """Hits without a text or an id, and a question that is null."""
    queries = stage(st.label_queries(spark, sf_dir), "queries")
    hits = search.knn(st.vector_collection(spark, sf_dir), queries, fields=retrieval.HIT_FIELDS)
    entity = F.struct(
        F.when(F.col("rank") % 3 != 0, F.col("entity.text")).alias("text"),
        F.when(F.col("rank") % 4 != 0, F.col("entity.pmid")).alias("pmid"),
    )
    question = F.when(F.col("query_id") % 2 == 0, F.format_string("What is label %d about?", "query_id"))
    texts = queries.select("query_id", question.alias("text"))
    return prompts.message_columns(prompts.messages(texts, hits.withColumn("entity", entity)))


def _corpus(spark, sf_dir):
    return corpus.build_corpus(st.articles(spark, sf_dir), corpus.hashing(DIM))


@query
def corpus_ids(spark, sf_dir):
    return _corpus(spark, sf_dir).select("id", "pmid", "section", "chunk_no", "text")


@query
def search_texts(spark, sf_dir):
    hits = retrieval.search_texts(_corpus(spark, sf_dir), st.questions(spark, sf_dir), corpus.hashing(DIM))
    return hits.select("query_id", "rank", "id", "score", "entity.pmid", "entity.section")


@query
def rag_end_to_end(spark, sf_dir):
    """Documents to chunks, vectors and ids; questions to hits and prompts."""
    built = retrieval.retrieve_and_prompt(_corpus(spark, sf_dir), st.questions(spark, sf_dir), corpus.hashing(DIM))
    return prompts.message_columns(built)
