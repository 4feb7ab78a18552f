import random
import re
from collections import Counter

import numpy as np

from litvec.llm import decontaminate

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def by_hand(docs, items):
    """Best window of each document for each item, of all windows with the item's number of words."""
    out = {}
    for d, text in docs:
        words = words_of(text)
        for k, item in items:
            wanted = words_of(item)
            n, target = len(wanted), shingles(wanted)
            for s in range(len(words) - n + 1 if n else 0):
                own = shingles(words[s : s + n])
                shared = sum((own & target).values())
                similarity = shared / (own.total() + target.total() - shared)
                if similarity >= 0.8 and similarity > out.get((d, k), (0, 0))[0]:
                    out[d, k] = similarity, s
    return out


def found(spark, docs, items):
    rows = decontaminate.contamination(
        spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS)
    ).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in rows}


def test_against_all_windows(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(n)).capitalize() + "?") for k, n in enumerate([1, 3, 5, 8, 20, 20, 45, 45, 70, 120])]
    items += [(20, None), (21, ""), (22, "..."), (23, "la " * 30)]
    docs = [(1000, None), (1001, ""), (1002, "short"), (1003, "la " * 29), (1004, "la " * 400)]
    for i in range(120):
        words = text(rnd.randint(0, 200))
        for _ in range(rnd.randint(0, 2)):
            passage = words_of(rnd.choice(items[:10])[1])
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                p = rnd.randrange(len(passage))
                passage[p : p + rnd.randint(0, 2)] = text(rnd.randint(0, 2))
                passage = passage or ["a"]
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, "  ".join(words) + "!"))
    got, wanted = found(spark, docs, items), by_hand(docs, items)
    assert got.keys() == wanted.keys()
    assert all(abs(got[k][0] - wanted[k][0]) < 1e-12 for k in got)
    assert len(got) > 40


def test_passes_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 3)
    items = [(k, f"item number {k} asks about the thing called {k * 7919} and its {k * 31} parts") for k in range(8)]
    docs = [(k, f"Before. {t}. Behind.") for k, t in items] + [(99, "nothing of that kind is in this document at all")]
    assert found(spark, docs, items).keys() == {(k, k) for k in range(8)}
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", item_id int")
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, ITEMS))
    assert [tuple(r) for r in kept.collect()] == [(99, docs[-1][1], 1)]
    repeated = spark.createDataFrame([items[0]] * 7 + items, ITEMS)
    assert decontaminate.drop_contaminated(df, repeated).count() == 1
    assert decontaminate.contamination(df, repeated).where("doc_id = 0").count() == 8


def test_empty_tables_null_ids_and_repeated_rows(spark):
    item = "which of the following seven words is the only one that fits"
    items, docs = [(1, item)], [(None, item), (5, item), (5, item)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(str(r.doc_id) for r in decontaminate.contamination(d, i).collect()) == ["5", "5", "None"]
    assert decontaminate.contamination(d.limit(0), i).count() == 0
    assert decontaminate.contamination(d, i.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(d, i.limit(0)).count() == 3


def random_print(rnd):
    return np.array([rnd.getrandbits(64) for _ in range(decontaminate.BLOCKS)], "u8")


def test_index_finds_everything_within_the_radius():
    items = decontaminate.Items(list(range(40)), [" ".join(f"w{i * j % 97}" for j in range(30)) for i in range(1, 41)])
    rnd = random.Random(2)
    for k in range(40):
        for flips in (0, 1, 10, 39, decontaminate.RADIUS, decontaminate.RADIUS + 1):
            mask = sum(1 << b for b in rnd.sample(range(decontaminate.BITS), flips))
            mask = np.array([mask >> 64 * i & (1 << 64) - 1 for i in range(decontaminate.BLOCKS)], "u8")
            near = items.within_radius(30, items.prints[k] ^ mask)
            assert (k in near) == (flips <= decontaminate.RADIUS)
    assert decontaminate.NEAR.sum() + decontaminate.BLOCKS > decontaminate.RADIUS


def test_blocks_leave_out_nearly_all_other_items():
    rnd = random.Random(6)
    items = decontaminate.Items(list(range(2000)), [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(2000)])
    met = [len(items.candidates(30, random_print(rnd))) for _ in range(200)]
    assert sum(met) / len(met) < 0.02 * 2000
    assert not len(items.candidates(31, random_print(rnd)))


def test_similar_texts_are_within_the_radius():
    """Pairs that just reach the similarity: five shingles and four of them, ten and eight, and many."""
    rnd, misses = np.random.default_rng(3), 0
    for shared, a, b in [(4, 0, 1), (8, 1, 1), (8, 0, 2), (16, 2, 2), (40, 5, 5), (200, 25, 25)]:
        for _ in range(300):
            x = rnd.integers(0, 1 << 63, shared + a + b, dtype="u8")
            runs = np.concatenate([x[: shared + a], x[:shared], x[shared + a :]])
            one, other = decontaminate.fingerprints(runs, np.array([shared + a, shared + b]))
            misses += int(np.bitwise_count(one ^ other).sum()) > decontaminate.RADIUS
    assert not misses


def test_documents_shorter_than_the_item_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([3, 5, 6, 9, 14, 20, 60, 60])]
    items.append((8, "la " * 30))
    docs = [(0, " ".join(words_of(items[6][1])[:-5])), (1, "la " * 29), (2, "la " * 24), (3, "la " * 25)]
    for i in range(150):
        words = words_of(rnd.choice(items)[1])
        for _ in range(rnd.choice([1, 1, 2, 4, 9])):
            p = rnd.choice([0, len(words) - 1, rnd.randrange(len(words))]) if words else 0
            words[p : p + 1] = rnd.choice([[], [], ["other"]])
        docs.append((10 + i, " ".join(words)))
    wanted = by_hand(docs, items)
    for d, text in docs:
        own = shingles(words_of(text))
        for k, item in items:
            target = shingles(words_of(item))
            similarity = (own & target).total() / max(1, (own | target).total())
            if len(words_of(text)) < len(words_of(item)) and similarity >= 0.8:
                wanted[d, k] = similarity, 0
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(*frames, shorter=True).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k][0]) < 1e-12 for k in got)
    assert (0, 6) in got and (3, 8) in got and len(got) > 30
    kept = {r.doc_id for r in decontaminate.drop_contaminated(*frames).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in wanted}
