import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from litvec.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes, fan_out):
    """Root and, for every node, its siblings and what folds to the root."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, _ in enumerate(nodes):
            a = i - i % fan_out
            run = nodes[a : a + fan_out]
            for leaf in below[i]:
                paths[leaf].append((run[: i - a], run[i - a + 1 :]))
        below = [sum(below[a : a + fan_out], []) for a in range(0, len(nodes), fan_out)]
        nodes = [sha("".join(nodes[a : a + fan_out])) for a in range(0, len(nodes), fan_out)]
    return nodes[0], paths


def by_hand(rows, fan_out=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    trees = [tree([leaf_of(r) for r in sorted(groups[g], key=order)], fan_out) for g in names]
    root, tops = tree([t[0] for t in trees], fan_out)
    out = []
    for g, (subroot, paths), top in zip(names, trees, tops):
        for r, path in zip(sorted(groups[g], key=order), paths):
            path = path + top
            tampered = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                tampered["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf_of(tampered)
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(h for before, after in path for h in before + after))
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def found(df, **kinds):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in queries.manifest_checked(df, **kinds).select(*columns).collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


def made(n, seed, langs=("en", "de", None, "", "Zz", "é")):
    rnd = random.Random(seed)
    pick = lambda *values: rnd.choice(values)
    return [
        {
            "doc_id": i,
            "text": pick(None, "", "abc", "Some TEXT é Ä", "Z" * 50),
            "lang": rnd.choice(langs),
            "source": pick("web", None, "ü"),
            "n_chars": pick(None, 3, -7),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("fan_out", [2, 3, 8])
def test_against_a_tree_built_by_hand(spark, fan_out):
    rows = made(150, fan_out)
    assert found(frame(spark, rows).repartition(3), fan_out=fan_out) == by_hand(rows, fan_out)


def test_a_hot_group_beside_groups_of_one_row(spark):
    rows = made(530, 5, ("en",)) + [{**r, "doc_id": 1000 + i, "lang": f"l{i}"} for i, r in enumerate(made(70, 6))]
    assert found(frame(spark, rows)) == by_hand(rows)


def test_repeated_rows_null_ids_one_row_and_empty_table(spark):
    rows = made(20, 7)
    rows += rows[:9] + [{**r, "doc_id": None} for r in rows[:5]] + [{**rows[0], "text": "other"}]
    assert found(frame(spark, rows)) == by_hand(rows)
    assert found(frame(spark, rows[:1])) == by_hand(rows[:1])
    assert found(frame(spark, [])) == []


def test_clashing_names_and_a_long_text(spark):
    rows = made(30, 8, ("en", "de")) + [{"doc_id": 77, "text": "Ab" * 2_000_000, "lang": "en", "source": None, "n_chars": 1}]
    more = frame(spark, rows)
    for name in ("grp", "node", "hash", "leaf", "path", "id", "name", "h0", "carried", "n", "root"):
        more = more.withColumn(name, F.lit("x"))
    assert found(more) == by_hand(rows)


def test_a_binary_tree_names_slot_zero_by_xor(spark):
    plan = merkle.build(frame(spark, made(5, 9, ("en",))), merkle.digest(*FIELDS), "lang", ["doc_id"], fan_out=2)
    assert [lv.count() for lv in plan.levels] == [3, 2, 1]


def test_digest_tells_nulls_lengths_and_values_apart(spark):
    row = spark.createDataFrame([(None, "é:", 12)], "a string, b string, c long")
    assert row.select(merkle.digest("a", "b", F.col("c"))).first()[0] == sha("-3:é:2:12")
