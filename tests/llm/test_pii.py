import hashlib
import random
import re

from litvec.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    spans = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def found(spark, rows, columns="doc_id long, text string"):
    return pii.digests(pii.find_pii(spark.createDataFrame(rows, columns)))


def test_base_spans_against_plain_search(spark):
    rnd = random.Random(1)
    parts = [
        "a.b@c.d", "x@y", "@z.w", "a@b.c_d@e.f", "me@mail-7.example.com.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255",
        "1.2.3", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (555) 555-0100", "+49 30 123456", "+1", "+123456789012345678",
        "12345678901234567890", "é😀", "\n", "word", "--", "%+-", "1 2 3", "().", "0" * 300 + ".1.1.1", "9" * 40,
    ]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "  ", "-", "."]) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "a" * 200_000 + "@b.c", "a@b.c " * 3000, "7" * 100_000, "1." * 50_000, "+1 " * 20_000]
    rows = list(enumerate(texts))
    for r, (_, text) in zip(found(spark, rows).orderBy("doc_id").collect(), rows):
        wanted = by_hand(text)
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest(), (text or "")[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in wanted.split(",")) for k in PATTERNS]
        assert set(wanted.split(",")) - {""} <= set(r.spans.split(","))


def test_contexts_find_what_patterns_miss(spark):
    rnd = random.Random(2)
    rows = [(i, f"{rnd.choice(['Hello', 'Please'])}, write to user{i}@host{i % 7}.example.org today") for i in range(30)]
    rows += [(100, "Ok, write to admin@localhost today"), (101, "Version 2.0 of admin@localhost2 is out"), (102, "we write to 555 people")]
    got = {r.doc_id: r for r in found(spark, rows).collect()}
    assert got[100].spans == "email:13:28" and got[100].n_email == 0 and got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[101].spans == got[102].spans == ""


def test_copies_of_one_text_teach_nothing(spark):
    rows = [(i, "write to me@host.example.org today") for i in range(50)] + [(100, "write to admin@localhost today")]
    assert {r.doc_id: r.spans for r in found(spark, rows).collect()}[100] == ""


def test_null_ids_repeated_rows_empty_table_and_clashing_names(spark):
    rows = [(None, "a@b.c", 1), (3, "a@b.c", 2), (3, "a@b.c", 2), (4, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, email int").selectExpr("*", "email as body", "email as seen", "email as `row`")
    got = sorted(((r.doc_id, r.spans) for r in pii.digests(pii.find_pii(df)).collect()), key=str)
    assert got == sorted([(None, "email:0:5"), (3, "email:0:5"), (3, "email:0:5"), (4, "")], key=str)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.find_pii(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_many_identifiers_in_one_text_and_at_the_rims_of_pieces(spark):
    many = "x@y.z 1.2.3.4 " * 6000
    rims = "".join("é" * (pii.PIECE - 20 + k) + f" write to a{k}@b.co now " for k in range(40))
    rows = found(spark, [(1, many), (2, rims)]).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip) for r in rows] == [(6000, 6000), (40, 0)]
    for r, text in zip(rows, (many, rims)):
        assert r.base_sha256 == hashlib.sha256(by_hand(text).encode()).hexdigest()


def test_contexts_do_not_depend_on_where_pieces_end(spark):
    leads = (0, 1, pii.PIECE - 12, pii.PIECE - 5, pii.PIECE - 1, 2 * pii.PIECE - 9)
    texts = ["ü" * lead + " call our office 555 now please" for lead in leads]
    df = spark.createDataFrame([(t, t.index("555")) for t in texts], "text string, at int")
    got = df.select(pii._context(pii._pieces(df.text), df.at, df.at + 3).alias("c")).collect()
    assert [r.c for r in got] == [["< our office", "<> our office _ now"]] * len(texts)


def test_overlaps_by_halving(spark):
    rnd, rows = random.Random(4), []
    for n in (0, 1, 2, 3, 7, 30):
        ends = sorted(rnd.sample(range(200), 2 * n))
        spans = list(zip(ends[::2], ends[1::2]))
        rows += [(spans, a, a + w) for a in range(0, 200, 7) for w in (1, 5, 40)]
    df = spark.createDataFrame(rows, "spans array<struct<start:int,end:int>>, a int, b int")
    got = [r.c for r in df.select(pii._overlaps(df.spans, df.a, df.b).alias("c")).collect()]
    assert got == [any(s < b and e > a for s, e in spans) for spans, a, b in rows]
