import random

import corpus_pipeline
from litvec.llm import sequences
from litvec.llm.queries import vocabulary
from tests.llm import test_near


def planted(folder, spark):
    """A small corpus where every stage has something to do, and what has to be left of it."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 7)))
    clean = [(i, " ".join(word() for _ in range(rnd.randint(5, 120))) + ".") for i in range(200)]
    toxic = []
    for i in range(60):
        words = [word() for _ in range(50)]
        for _ in range(4):
            words.insert(rnd.randrange(50), rnd.choice(["grobian", "zorkend", "flumpf"]))
        toxic.append((1000 + i, " ".join(words) + "."))
    copies = [(2000 + i, t.replace(" ", " \n")) for i, (_, t) in enumerate(clean[:20])]
    long = [(i, t) for i, t in clean if len(t.split()) > 70][:10]
    near = [(3000 + i, t + " tail") for i, t in long]
    items = [(i, " ".join(word() for _ in range(25))) for i in range(10)]
    leaked = [(4000 + i, " ".join(word() for _ in range(20)) + " " + t + " " + " ".join(word() for _ in range(20))) for i, t in items]
    rows = clean + toxic + copies + near + leaked
    labels = [(i, 1, 0) for i, _ in clean[:150]] + [(i, 0, 1) for i, _ in toxic[:45]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, {i for i, _ in clean}, {"toxic": {i for i, _ in toxic}, "copies": {i for i, _ in copies}, "near": {i for i, _ in near}, "leaked": {i for i, _ in leaked}}


def test_stages_keep_what_is_clean(spark, tmp_path):
    folder = str(tmp_path)
    rows, clean, gone = planted(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    left = {i for i, _ in rows}
    for (name, step), out in zip(corpus_pipeline.STAGES[:-1], ("toxic", "copies", "near", "leaked")):
        before = docs
        docs = step(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.dtypes == columns
        left -= gone[out]
        if out == "near":  # what links of 0.8 join, by comparison of all pairs
            texts = [(r.doc_id, r.text) for r in before.collect()]
            left = {d for d, c in test_near.classes_by_hand(texts).items() if d == c}
            assert not left & gone["near"]
        assert {r.doc_id for r in docs.collect()} == left
    assert left == clean
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {i: t for i, t in rows}
    pieces = sequences.pack(docs.select("doc_id", "text"), vocabulary()).collect()
    assert {r.doc_id for r in found} == clean
    assert sum(r.length for r in found) == sum(p.length for p in pieces) == sum(
        len(x) + 1 for x in sequences.WordEncoder(vocabulary())([ids[i] for i in clean])
    )


def test_empty_documents(spark, tmp_path):
    planted(str(tmp_path / "full"), spark)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


