import math
import random
import re
from collections import Counter

import pytest

from litvec.functions.packing import Splitter, chunks
from litvec.operators import sentences as st

CLOSERS = "\"'”’»)\\]}"


def word_type(word):
    bare = re.sub(r"\A[\W_]+|[\W_]+\Z", "", word).lower()
    return "#" if re.fullmatch(r"[0-9][0-9.,]*", bare) else bare


def mark(word):
    tail = re.search(rf"([.!?]+)[{CLOSERS}]*\Z", word)
    if tail:
        if re.search("[!?]", tail[1]):
            return "!"
        return "…" if len(tail[1]) > 1 else "." if tail.start() and re.match(r"[^\W_]", word[tail.start() - 1]) else "!"
    return "," if re.search(r"[^\W_]\.[^\w.]+\Z", word) else ""


def ratio(k12, c1, c2, n):
    def fit(k, m, p):
        return (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)

    p = c2 / n
    return 2 * (fit(k12, c1, k12 / c1) + fit(c2 - k12, n - c1, (c2 - k12) / (n - c1)) - fit(k12, c1, p) - fit(c2 - k12, n - c1, p))


def by_hand(texts):
    """The model by dictionaries on the driver."""
    n, dotted, after = Counter(), Counter(), Counter()
    for text in texts:
        words = (text or "").split()
        if words and word_type(words[0]):
            after["", "^", word_type(words[0])] += 1
        for i, w in enumerate(words):
            t, m = word_type(w), mark(w)
            n[t] += t != ""
            dotted[t] += t != "" and m in (".", ",")
            if m in ("!", ".") and i + 1 < len(words) and word_type(words[i + 1]):
                after[t, m, word_type(words[i + 1])] += 1
    total, stops = sum(n.values()), sum(dotted.values())
    found = {}
    for t in n:
        k, plain, letters = dotted[t], n[t] - dotted[t], len(t.replace(".", ""))
        if not k or not re.search(r"[^\W\d_]", t):
            continue
        p = stops / total
        null = k * math.log(p) + (plain * math.log(1 - p) if plain else 0)
        score = -2 * (null - k * math.log(0.99) - plain * math.log(1 - 0.99))
        score *= math.exp(-letters) * (len(t) - letters + 1) * letters ** -float(plain)
        if score >= 0.3:
            found["abbreviation", t] = (n[t], k, score)

    def behind(pairs, kind, least):
        ends, joint = sum(pairs.values()), Counter()
        for (_, _, t), c in pairs.items():
            joint[t] += c
        for t, k in joint.items():
            if re.search(r"[^\W\d_]", t) and k / ends > n[t] / total and ratio(k, ends, n[t], total) >= least:
                if ("starter", t) not in found:
                    found[kind, t] = (n[t], k, ratio(k, ends, n[t], total))

    behind({p: c for p, c in after.items() if ("abbreviation", p[0]) not in found and (len(p[0]) > 1 or p[1] != ".")}, "starter", 30)
    behind({p: c for p, c in after.items() if p[:2] == ("#", ".")}, "ordinal", 7.88)
    return found


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    nouns = ["cells", "mice", "models", "patients", "results", "proteins", "doses", "trials", "samples", "genes"]
    verbs = ["grew", "failed", "improved", "were", "showed", "bound"]
    lines = []
    for _ in range(n):
        a, b, c = rnd.choice(nouns), rnd.choice(verbs), rnd.choice(nouns)
        lines.append(
            rnd.choice(
                [
                    f"The {a} {b} as shown in Fig. {rnd.randint(1, 9)} by Smith et al. in trials.",
                    f"We {b} many {a}, e.g. {c} and {a}.",
                    f"In {a} we found {c} (see Fig. {rnd.randint(1, 9)}). The {c} {b} well!",
                    f"On 3. Oktober the {a} {b}. We saw {c}?",
                    f"The {a} {b} many {c}. In {c} this {b}.",
                ]
            )
        )
    return lines


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(corpus())], "doc_id long, text string, type string")
    return st.learn(df.repartition(3))


def test_model_equals_one_made_on_the_driver(learned):
    expected = by_hand(corpus())
    found = {(r.kind, r.type): (r.n, r.together, r.score) for r in learned.collect()}
    assert set(found) == set(expected)
    for key, (n, k, score) in expected.items():
        assert found[key][:2] == (n, k) and found[key][2] == pytest.approx(score, rel=1e-9)
    kinds = {k: {t for kind, t in found if kind == k} for k in ("abbreviation", "starter", "ordinal")}
    assert {"al", "fig", "e.g"} <= kinds["abbreviation"] and not kinds["abbreviation"] & {"trials", "cells", "genes", "well"}
    assert {"the", "in", "we"} <= kinds["starter"] and "oktober" in kinds["ordinal"]


def test_ends_behind_abbreviations_initials_and_ordinals(spark, learned):
    model = st.SentenceModel.of(learned)
    texts = [
        "As Smith et al. showed in Fig. 2, cells grew. Mice, e.g. old ones, failed.",
        "It was made by J. Doe on 3. Oktober of 2020. The end came (see Fig. 3). So it was.",
        'He said "It works." Then he left... and came back. Was it 5. No!',
        "By Smith et al. The cells grew. 7 of 9 failed?! yes",
        "",
        None,
        " ",
        "one",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", model.sentences("text").alias("s")).collect()}
    assert got[0] == ["As Smith et al. showed in Fig. 2, cells grew.", "Mice, e.g. old ones, failed."]
    assert got[1] == ["It was made by J. Doe on 3. Oktober of 2020.", "The end came (see Fig. 3).", "So it was."]
    assert got[2] == ['He said "It works."', "Then he left... and came back.", "Was it 5.", "No!"]
    assert got[3] == ["By Smith et al.", "The cells grew.", "7 of 9 failed?!", "yes"]
    assert [got[i] for i in range(4, 8)] == [[], None, [], ["one"]]
    rows = st.split_sentences(df.withColumnRenamed("doc_id", "sentence"), model).collect()
    assert [(r.sentence_no, r.text) for r in rows if r.sentence == 7] == [(0, "one")]


def test_pieces_are_the_text_again(spark, learned):
    model = st.SentenceModel.of(learned)
    texts = [*corpus(5, 40), "a.b. c.  d!\n\n(e.) f", "et al. et al.", "...", ". . .", "x." * 2000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", model.sentence_pieces("text").alias("p")).collect():
        assert "".join(r.p) == " ".join(r.text.split())


def test_chunks_keep_learned_sentences_whole(spark, learned):
    model = st.SentenceModel.of(learned)
    df = spark.createDataFrame([("We know Fig. 2 well. The cells grew.",)], "text string")
    plain = df.select(chunks("text", 5)["text"].alias("c")).first().c
    better = df.select(chunks("text", 6, Splitter(sentences=model.sentence_pieces))["text"].alias("c")).first().c
    assert plain == ["We know Fig.", "2 well.", "The cells grew."]
    assert better == ["We know Fig. 2 well", ".", "The cells grew."] or better[-1] == "The cells grew."


def test_empty_corpus_and_too_many_words(spark, learned):
    empty = st.learn(spark.createDataFrame([(None,), ("",)], "text string"))
    assert empty.count() == 0
    model = st.SentenceModel.of(empty)
    df = spark.createDataFrame([("Ab c. Cd ef. Gh",)], "text string")
    assert df.select(model.sentences("text").alias("s")).first().s == ["Ab c. Cd ef.", "Gh"]
    with pytest.raises(ValueError, match="more than 2"):
        st.SentenceModel.of(learned, most=2)


def test_patterns_meet_each_spelling_once(spark):
    df = spark.createDataFrame([("One two. One two! one",), ("",), (None,), ("Two. One",)], "text string")
    counts = st.word_counts(df)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "\\p{L}" not in plan[plan.index("Generate") :]  # types and marks are made of counted spellings
    got = {(r["type"], r["mark"], r["next"], r["n"]) for r in counts.collect()}
    assert got == {
        ("", "^", "one", 1), ("", "^", "", 1), ("", "^", "two", 1), ("", "", None, 1), ("one", "", None, 4),
        ("two", ".", "one", 2), ("two", "!", "one", 1),
    }
