import numpy as np
import pytest
from pyspark.sql import functions as F

from litvec.functions import nearest
from litvec.operators import prompts, search


def frame(spark, vectors, name="id"):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


def brute(corpus, queries, metric, k):
    corpus, queries = (np.float32(m).astype(float) for m in (corpus, queries))
    if metric == "L2":
        score = np.linalg.norm(queries[:, None] - corpus[None], axis=2)
    else:
        if metric == "COSINE":
            corpus, queries = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (corpus, queries))
        score = queries @ corpus.T
    score = np.round(score, 9)
    best = []
    for q, row in enumerate(score):
        order = sorted(range(len(row)), key=lambda i: (row[i] if metric == "L2" else -row[i], i))[:k]
        best += [(q, rank + 1, i, pytest.approx(row[i], abs=2e-9)) for rank, i in enumerate(order)]
    return best


def found(hits):
    rows = hits.select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_exact_search(spark, metric):
    rng = np.random.default_rng(3)
    corpus, queries = rng.normal(size=(400, 8)) * 3, rng.normal(size=(9, 8))
    corpus[50:150] = corpus[49]  # many copies: ties go to the smaller id
    corpus[7] = 0
    queries[0] = corpus[49]
    hits = search.knn(frame(spark, corpus).repartition(5), frame(spark, queries, "query_id"), 12, metric)
    assert found(hits) == brute(corpus, queries, metric, 12)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    corpus, queries = rng.normal(size=(150, 4)), rng.normal(size=(23, 4))
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", 0)
    monkeypatch.setattr(nearest, "_ROWS", 6)
    monkeypatch.setattr(nearest, "_QUERIES", 2)
    monkeypatch.setattr(nearest, "_BUFFERED", 10)
    monkeypatch.setattr(search, "_MANY_SLOTS", 0)
    hits = search.knn(frame(spark, corpus), frame(spark, queries, "query_id"), 4)
    assert found(hits) == brute(corpus, queries, "COSINE", 4)


def test_fewer_rows_than_k_and_missing_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<float>")
    query = spark.createDataFrame([("q", [2.0, 1.0])], "query_id string, vector array<double>")
    rows = search.knn(corpus, query, 5).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [("q", 1), ("q", 3)]
    assert search.knn(corpus.where("id > 9"), query).count() == 0
    assert search.knn(corpus, query.where("query_id = ''")).count() == 0


def test_other_dimension_fails(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0])], "id long, vector array<float>")
    query = spark.createDataFrame([(1, [2.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    with pytest.raises(Exception, match="vectors of different lengths"):
        search.knn(corpus.coalesce(1), query, 5).collect()
    with pytest.raises(Exception, match="matmul"):
        search.knn(corpus.where("id = 1"), query, 5).collect()


def test_arguments(spark):
    df = frame(spark, np.eye(2))
    with pytest.raises(ValueError):
        search.knn(df, df, metric="HAMMING")
    with pytest.raises(ValueError):
        search.knn(df, df, k=0)


@pytest.mark.parametrize("max_broadcast", [0, 100])
def test_filter_and_fields(spark, max_broadcast):
    corpus = frame(spark, np.eye(4)).withColumns(
        {"text": F.concat(F.lit("t"), "id"), "section": F.when(F.col("id") < 2, "abstract").otherwise("intro")}
    )
    query = frame(spark, np.eye(4)[:1], "query_id")
    fields = ["text", "section", "sentence"]
    rows = search.knn(corpus, query, 2, where="section = 'intro'", fields=fields).orderBy("rank").collect()
    assert [(r.id, r.entity.text, r.entity.section) for r in rows] == [(2, "t2", "intro"), (3, "t3", "intro")]
    hits = search.with_entity(search.knn(corpus, query, 1), corpus, fields, max_broadcast=max_broadcast)
    assert search.entities(hits).columns == ["query_id", "rank", "score", "text", "section"]
    assert hits.count() == 1


def test_cells(spark):
    rng = np.random.default_rng(5)
    corpus, queries = rng.normal(size=(500, 6)), rng.normal(size=(20, 6))
    table = frame(spark, corpus)
    centroids = search.fit_cells(table, 8)
    celled = search.assign_cells(table, centroids)
    asked = frame(spark, queries, "query_id")
    exact = search.knn(table, asked, 10)
    assert found(search.knn_cells(celled, asked, centroids, 8)) == found(exact)
    shares = [
        search.recall(search.knn_cells(celled, asked, centroids, p), exact).agg(F.avg("recall")).first()[0] for p in (1, 3, 8)
    ]
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] > 0.6


def hits(spark):
    rows = [
        (1, 2, 0.5, ("second", "22", "intro", None)),
        (1, 1, 0.9, ('the "first"\nline', "11", "abstract", None)),
        (2, 1, 0.3, ("other", "33", "intro", None)),
    ]
    entity = "struct<text: string, pmid: string, section: string, sentence: string>"
    return spark.createDataFrame(rows, f"query_id long, rank int, score double, entity {entity}")


def questions(spark):
    return spark.createDataFrame([(1, 'what "is" it'), (2, "why"), (3, "none")], "query_id long, text string")


def test_prompt(spark):
    rows = {r.query_id: r for r in prompts.message_columns(prompts.messages(questions(spark), hits(spark))).collect()}
    lines = ' - "the "first"\nline" {"pmid":"11"}\n         - "second" {"pmid":"22"}\n        '
    assert rows[1].system == prompts.ROLE
    assert rows[1].user == prompts.TASK + 'Question: "what "is" it".\nContext:\n' + lines
    assert rows[3].user == prompts.TASK + 'Question: "none".\nContext:\n'


def test_prompt_options(spark):
    out = prompts.messages(questions(spark), hits(spark), role="R", task="T ", escape=True).where("query_id = 1").first()
    assert out.messages[0].asDict() == {"role": "system", "content": "R"}
    assert out.messages[1].role == "user"
    assert out.messages[1].content.startswith('T Question: "what \\"is\\" it".\nContext:\n - "the \\"first\\"\nline" {')


def test_tagged_prompt(spark):
    rows = {r.query_id: r for r in prompts.message_columns(prompts.tagged(questions(spark), hits(spark))).collect()}
    assert rows[2].user == (
        prompts.TAGGED_TASK + "<context>other</context><pmid>33</pmid>\n<question>why<\\question>\n"
        "Here are some restrictions: \nOnly use academic papers from pubmed or biorxiv to support your answer. \n\n"
    )
    assert rows[2].system == prompts.TAGGED_ROLE
    closed = prompts.tagged(questions(spark), hits(spark), well_formed=True).where("query_id = 2").first()
    assert "why</question>" in closed.messages[1].content


def test_bad_vectors_have_no_neighbours(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += [(1000, [float("nan")] * 8), (1001, [None] + [1.0] * 7), (1002, None), (1003, [float("inf")] * 8)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = [(0, good[0].tolist()), (1, [float("nan")] * 8), (2, [None] * 8), (3, None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    for metric in search.METRICS:
        hits = search.knn(corpus, queries, 10, metric).collect()
        assert len(hits) == 10 and {h.query_id for h in hits} == {0} and max(h.id for h in hits) < 1000


def test_small_scores_rank_by_value(spark):
    corpus = spark.createDataFrame([(i, [i * 1e-10]) for i in (1, 2, 3)], "id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>")
    assert [h.id for h in search.knn(corpus, queries, 3, "IP").orderBy("rank").collect()] == [3, 2, 1]
    assert [h.id for h in search.knn(corpus, spark.createDataFrame([(0, [0.0])], queries.schema), 3, "L2").orderBy("rank").collect()] == [1, 2, 3]


def test_blocks_give_the_same_hits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.selectExpr("id as query_id", "vector")
    whole = search.knn(corpus, queries, 4).orderBy("query_id", "rank").collect()
    assert search.knn(corpus, queries, 4, block_bytes=2000).orderBy("query_id", "rank").collect() == whole


def test_cells_of_every_metric_prune_and_take_filters(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, (v * rng.uniform(0.1, 9)).tolist(), i % 2) for i, v in enumerate(rng.normal(size=(300, 6)))] + [(999, None, 0)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, kind int")
    queries = corpus.where("id < 5").selectExpr("id as query_id", "vector")
    for metric in search.METRICS:
        centroids = search.fit_cells(corpus, 6, metric=metric)
        search.save_centroids(spark, centroids, str(tmp_path / metric))
        assert np.allclose(search.load_centroids(spark, str(tmp_path / metric)), centroids)
        cells = search.assign_cells(corpus, centroids, metric=metric)
        assert [r.id for r in cells.where("cell is null").collect()] == [999]
        cells.write.partitionBy("cell").parquet(str(tmp_path / f"{metric}-cells"))
        stored = spark.read.parquet(str(tmp_path / f"{metric}-cells"))
        found = search.knn_cells(stored, queries, centroids, 6, 5, metric, where="kind = 1", fields=("kind",))
        exact = search.knn(corpus, queries, 5, metric, where="kind = 1")
        assert found.select("query_id", "rank", "id").exceptAll(exact.select("query_id", "rank", "id")).count() == 0
        assert {r.entity.kind for r in found.collect()} == {1}
        few = search.knn_cells(stored, queries.where("query_id = 0"), centroids, 1, 5, metric)
        assert "PartitionFilters: [isnotnull(cell" in few._jdf.queryExecution().toString()


def test_fields_of_many_hits_move_the_named_rows_only(spark):
    corpus = spark.range(3000).selectExpr("id", "array(cast(id as double), 1.0) as vector", "repeat('x', 10) as text")
    queries = corpus.where("id < 40").selectExpr("id as query_id", "vector")
    found = search.knn(corpus, queries, 5, "L2")
    few, many = (search.with_entity(found, corpus, ("text",), max_broadcast=n) for n in (1000, 100))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 200
    assert "LeftSemi, BuildRight" in many._jdf.queryExecution().toString()
