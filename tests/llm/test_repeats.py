import random

import pytest

from litvec.llm import repeats


def by_hand(rows):
    """Runs of bytes under strings of 100 bytes that start earlier too."""
    seen, out = {}, {}
    for doc, text in sorted(r for r in rows if r[0] is not None):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if seen.setdefault(data[s : s + 100], (doc, s)) != (doc, s):
                gone[s : s + 100] = b"\1" * 100
        runs, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            stop = gone.find(0, start)
            at = len(data) if stop < 0 else stop
            runs.append((start, at))
        out[doc] = (runs, b"".join(data[i : i + 1] for i in range(len(data)) if not gone[i]))
    return out


def letters(seed, n, alphabet="abcdefghij "):
    return "".join(random.Random(seed).choices(alphabet, k=n))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choices("abcdefgh éü ", k=n))
    base = [word(rnd.randint(50, 600)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "ab" * 50), (3, "ab" * 50), (4, "a" * 99), (5, "a" * 101), (6, "x" * 5000)]
    for i in range(150):
        text = ""
        for _ in range(rnd.randint(1, 4)):
            part, cut = rnd.choice(base), rnd.randint(0, 300)
            text += word(rnd.randint(0, 30)) + part[cut // 3 : len(part) - rnd.randint(0, 20)]
        if rnd.random() < 0.4:
            p = rnd.randrange(len(text))
            text = text[:p] + "#" + text[p + 1 :]
        rows.append((10 + i * 3, text))
    return rows


@pytest.mark.parametrize("seed, options", [(0, {}), (1, {"block": 3000, "group": 3}), (2, {"block": 10_000, "group": 40})])
def test_against_all_strings(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.remove_repeats(df, **options).collect()
    got = {r.doc_id: ([(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in found}
    assert got == by_hand(rows)


def test_one_passage_in_many_documents(spark):
    passage = letters(5, 400)
    rows = [(i, f"before {i * 7919} {passage} behind {i * 104729}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"group": 50}):
        found = repeats.remove_repeats(df, **options).collect()
        got = {r.doc_id: ([(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in found}
        assert got == by_hand(rows)


def test_null_ids_repeated_rows_empty_table_and_other_columns(spark):
    text = letters(6, 300)
    rows = [(None, text, 1), (None, text, 2), (4, text, 3), (4, text, 3), (5, text, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = sorted((r.doc_id or 0, r.n_bytes, len(r.spans), len(r.kept)) for r in repeats.remove_repeats(df).collect())
    assert found == [(0, 300, 0, 300), (0, 300, 0, 300), (4, 300, 0, 300), (4, 300, 0, 300), (5, 300, 1, 0)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_long_document_is_seen_in_segments(spark, monkeypatch):
    data = bytes(random.Random(8).choices(range(97, 123), k=3000))
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    parts = repeats.anchors(data)
    assert set(zip(whole[0].tolist(), whole[1].tolist())) == set(zip(parts[0].tolist(), parts[1].tolist()))
    served = sorted((a, b) for a, b in zip(parts[2].tolist(), parts[3].tolist()))
    assert served[0][0] == 0 and served[-1][1] == 2900
    assert all(b + 1 == c for (_, b), (c, _) in zip(served, served[1:]))


def test_maximal_repeats_have_all_occurrences():
    import numpy as np

    text = letters(9, 168).encode()
    other = text[:30] + b"#" + text[31:]
    before, behind = [text[:68], text[:68], other[:68]], [text[68:], text[68:], other[68:]]
    groups = list(repeats.repeats_of(np.array([1, 1, 1]), np.array([3, 1, 2]), np.array([68, 68, 68]), before, behind))
    # All three agree in strings that begin up to 37 bytes before the anchor, two of them in all 69.
    assert sorted(groups) == [([1, 0], 38, 68), ([1, 2, 0], 0, 37)]
