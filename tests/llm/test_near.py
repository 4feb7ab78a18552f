import random
import re
from collections import Counter

import numpy as np

from litvec.llm import near
from litvec.llm.common import components
from litvec.llm.words import by_occurrence, shingles, word_hashes


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def labelled(words):
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen, out = Counter(), set()
    for g in grams:
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def classes_by_hand(rows):
    """Smallest id of each class: equal words, or 0.8 of the labelled shingles."""
    parent = {d: d for d, _ in rows}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    texts = [(d, words_of(t), t or "") for d, t in rows]
    sets = {d: labelled(w) for d, w, _ in texts}
    for i, (d, w, t) in enumerate(texts):
        for e, v, u in texts[:i]:
            same = w == v if w or v else t == u
            shared = len(sets[d] & sets[e])
            if same or (shared and shared / (len(sets[d]) + len(sets[e]) - shared) >= 0.8):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: top(d) for d, _ in rows}


def corpus(seed, bases=25, copies=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(1, 6)))
    rows = []
    for b in range(bases):
        base = [word() for _ in range(rnd.choice([3, 5, 9, 40, 150, 600]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 12])):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.2:
                copy.insert(rnd.randrange(len(copy)), word())
            rows.append(" ".join(copy).capitalize() + ".")
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


def test_against_all_pairs(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, "!!"), (1003, "??"), (1004, "one"), (1005, "One!"), (1006, "w " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert got == classes_by_hand(rows)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, f"another text about {i} things that nobody else mentions {i * 7919}") for i in range(50)]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)


def test_nulls_repeated_rows_empty_table_and_other_columns(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (7, "a b c d e f", 3), (7, "a b c d e f", 3), (9, "A b, c d e f!", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    found = sorted(((r.doc_id, r.class_id) for r in near.near_duplicates(df).collect()), key=str)
    assert found == [(7, 7), (7, 7), (9, 7), (None, None), (None, None)]
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.class_id for r in kept.collect()) == [1, 2, 3, 3]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_alignment_heeds_the_order():
    x = np.arange(1, 101, dtype="u8")
    assert near.aligned_similarity(x, x) == 1.0
    assert near.aligned_similarity(x[:90], x) == 0.9
    assert near.aligned_similarity(np.concatenate([x[50:], x[:50]]), x) < 0.8
    assert near.aligned_similarity(x[:0], x) == 0.0
    swapped = x.copy()
    swapped[[10, 11]] = swapped[[11, 10]]
    assert 0.95 < near.aligned_similarity(swapped, x) < 1.0


def test_sketches_agree_by_chance_of_the_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, 400, dtype="u8")
        other = base.copy()
        other[rng.choice(400, 44, replace=False)] = rng.integers(0, 1 << 63, 44, dtype="u8")  # similarity 0.8
        a, b = (near.order_sketches(x, np.array([400]))[0] for x in (base, other))
        agree.append((a == b).mean())
    assert 0.55 < np.mean(agree) < 0.75


def test_hashes_of_words_and_shingles():
    texts = ["A b-c, d\ne_f é", "", "a B C d e f É", "x " * 3]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [7, 0, 7, 3]
    assert hashes[:7].tolist() == hashes[7:14].tolist()
    grams, many = shingles(hashes, counts)
    assert many.tolist() == [3, 0, 3, 1]
    assert grams[:3].tolist() == grams[3:6].tolist()
    x, m = shingles(*word_hashes(["a a a a a a a"]))
    assert len(set(x.tolist())) == 1 and len(set(by_occurrence(x, m).tolist())) == 3


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (None, 5), (6, None), (9, 9)]
    rng.shuffle(links)
    found = {r.id: r.class_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_planted_pairs_in_a_passage_that_hundreds_share(spark):
    rnd = random.Random(6)
    new = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    passage = new(180)
    text = lambda own: " ".join(own[:30] + passage + own[30:])
    rows = [(10 * i, text(new(60))) for i in range(600)]

    def sketched(texts):
        return near.order_sketches(*near._labelled(texts)[2:])

    common = sketched([t for _, t in rows])
    common = [{s for s, n in Counter(column).items() if n > 4 * near.SMALL} for column in common.T.tolist()]
    planted = 0
    while planted < 4:  # pairs that share sketches of the passage only, enough of them
        own = new(60)
        copy = list(own)
        for p in (6, 17, 24, 37, 52):
            copy[p] = new(1)[0]
        left, right = sketched([text(own), text(copy)]).tolist()
        agreeing = [s in common[j] for j, (s, t) in enumerate(zip(left, right)) if s == t]
        if len(agreeing) >= near.AGREEMENT and all(agreeing):
            rows += [(10**5 + planted, text(own)), (10**6 + planted, text(copy))]
            planted += 1
    wanted = {d: d if d < 10**6 else d - 10**6 + 10**5 for d, _ in rows}
    sets = {d: labelled(words_of(t)) for d, t in rows}
    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(similarity(10**5 + k, 10**6 + k) >= 0.8 for k in range(4)) and similarity(10, 20) < 0.8
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_a_pair_that_agrees_in_few_sketches_of_crowded_buckets(spark):
    rnd = random.Random(8)
    new = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]

    def sketched(words):
        x, many = near._labelled([" ".join(words)])[2:]
        return x, near.order_sketches(x, many)[0]

    while True:  # about one pair in a hundred
        a = new(100)
        b = [*a[:48], *new(1), *a[49:72], *new(1), *a[73:]]
        (x, left), (_, right) = sketched(a), sketched(b)
        agreeing = np.flatnonzero(left == right).tolist()
        if 1 <= len(agreeing) < near.AGREEMENT:
            break
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    for j in agreeing:
        g = (x ^ near._SEEDS[2 * j]) * (near._SEEDS[2 * j + 1] | np.uint64(1))
        low, high = sorted(np.argsort(g ^ (g >> np.uint64(32)))[:2].tolist())
        members = 0
        while members < near.SMALL:  # texts that share this sketch and little else
            words = [*a[low : low + 5], *new(6), *a[high : high + 5], *new(20)]
            if sketched(words)[1][j] == left[j]:
                rows.append((100 * (j + 1) + members, " ".join(words)))
                members += 1
    wanted = classes_by_hand(rows)
    assert wanted[2] == 1 and len(set(wanted.values())) == len(rows) - 1
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_ids_that_stand_for_several_texts_lose_none(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, unique, other = words(60), words(60), words(60)
    rows = [(3, a), (5, a + " end"), (5, unique), (7, other), (7, other + " end"), (7, other), (9, "x"), (9, "x"), (None, a), (None, a)]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, digest int")
    judged = near.near_duplicates(df).collect()
    assert sorted((r.class_id for r in judged), key=str) == sorted([3, 3, 5, 7, 7, 7, 9, 9, None, None], key=str)
    left = sorted(((r.doc_id, r.text) for r in near.drop_near_duplicates(df.repartition(3)).collect()), key=str)
    assert [d for d, _ in left] == [3, 5, 7, 7, 9, 9, None, None]
    assert (3, a) in left and (5, unique) in left and (9, "x") in left
    assert near.drop_near_duplicates(df).columns == df.columns


def test_rounds_end_when_they_join_few(spark, monkeypatch):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(120)]
    sketched = lambda words: near.order_sketches(*near._labelled([" ".join(words)])[2:]).tolist()
    copies = []
    while len(copies) < 20:  # near copies that share all their sketches, so all their buckets are crowded
        copy = list(base)
        copy[rnd.randrange(120)] = f"x{rnd.randrange(10**9)}"
        if sketched(copy) == sketched(base):
            copies.append(" ".join(copy))
    turns = []

    def few_pairs(large, classes, turn):
        ids = sorted(r.id for r in large.select("id").collect())
        turns.append(turn)
        links = list(zip(ids, ids[1:]))
        return spark.createDataFrame(links[:5] if turn == 1 else links[turn + 3 : turn + 4], "a long, b long")

    monkeypatch.setattr(near, "_with_hubs", lambda large: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near, "_random_pairs", few_pairs)
    found = near.near_duplicates(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"))
    assert [r.class_id for r in found.collect()] == [0] * 20
    assert turns == [1, 2]  # five of 20 classes are worth another round, one of 15 is not


def test_blocks_of_a_rare_shingle_visit_as_rows(spark, monkeypatch):
    def made(plan):
        """Rows that the explodes of visits made, in the plan that ran."""
        if plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
            return made(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan())
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.nodeName() == "Generate" and "visited" in plan.generatorOutput().toString()
        return sum(map(made, children)) + (plan.metrics().apply("numOutputRows").value() if own else 0)

    rnd = random.Random(12)
    words = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    n, passage = 200, words(60)
    monkeypatch.setattr(near, "BLOCK", 10)
    bodies = spark.createDataFrame([(i, f"{passage} {words(5)}") for i in range(n)], "doc_id long, text string")
    large = bodies.selectExpr("doc_id AS id", "array(1L) AS buckets")
    pairs = near._rare_pairs(large, bodies, bodies.selectExpr("doc_id AS id", "doc_id AS class_id"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(n) for a in range(b)}
    shared = 8  # of the first fifth, 13 shingles of 61, five are of a text alone
    assert 0 < made(pairs._jdf.queryExecution().executedPlan()) <= shared * (n // near.BLOCK) ** 2
