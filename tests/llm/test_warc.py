import gzip
import io
import random

import pytest

from litvec.llm import warc
from litvec.llm.queries import ORACLES, QUERIES

PAGES = "page_id long, url string, html string"


def members(n=20, seed=1):
    rnd = random.Random(seed)
    return [warc.page_record(i, f"http://h/{i}", rnd.randbytes(rnd.randint(0, 3000)), None) for i in range(n)]


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def ids(found):
    return [int(r["record_id"][10:-1]) for r in found if not r["gap"]]


@pytest.mark.parametrize("pack", [lambda r: gzip.compress(r, 1), lambda r: r])
def test_damage_costs_only_what_it_hits(pack):
    packed = [pack(r) for r in members()]
    whole = b"".join(packed)
    assert ids(read(whole)) == list(range(20)) and not [r for r in read(whole) if r["gap"]]
    start = sum(map(len, packed[:7]))

    hurt = bytearray(whole)
    hurt[start + len(packed[7]) // 2] ^= 0xFF
    found = read(bytes(hurt))
    assert ids(found) == [i for i in range(20) if i != 7]
    assert [(r["start"], r["end"]) for r in found if r["gap"]] == [(start, start + len(packed[7]))]

    found = read(whole[:start] + whole[start + 40 :])
    assert ids(found) == [i for i in range(20) if i != 7]

    noise = b"\x1f\x8b\x08 no member, WARC/1.0 no record" * 3
    found = read(noise + whole[:start] + noise + whole[start:] + noise)
    assert ids(found) == list(range(20)) and len([r for r in found if r["gap"]]) == 3

    found = read(whole[:-5])
    assert ids(found) == list(range(19)) and found[-1]["end"] == len(whole) - 5
    assert read(b"") == [] and [r["gap"] is not None for r in read(b"xyz")] == [True]


def test_every_cut_and_flip_is_survived():
    rnd = random.Random(2)
    packed = [gzip.compress(r, 1) for r in members(4)]
    whole = b"".join(packed)
    for _ in range(150):
        hurt = bytearray(whole)
        at = rnd.randrange(len(hurt))
        hurt[at : at + rnd.randint(0, 30)] = rnd.randbytes(rnd.randint(0, 30))
        found = read(bytes(hurt))
        assert found[0]["start"] == 0 and found[-1]["end"] == len(hurt)
        assert all(a["end"] == b["start"] for a, b in zip(found, found[1:]))
        assert len(ids(found)) >= 2


def test_wrong_length_and_wrong_digest_are_damage():
    records = members(5)
    longer = records[2].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    assert ids(read(b"".join([*records[:2], longer, *records[3:]]))) == [0, 1, 3, 4]
    other = records[2][:-6] + bytes([records[2][-6] ^ 1]) + records[2][-5:]
    found = read(b"".join([*records[:2], other, *records[3:]]))
    assert ids(found) == [0, 1, 3, 4] and [r["gap"] for r in found if r["gap"]] == ["payload digest differs"]


def pages(spark):
    rows = [
        (1, "http://a/ b\r\nWARC-Type: x", "same"), (2, None, "same"), (9, "http://c", "same"), (9, "http://d", "same"),
        (4, "http://e", None), (5, "http://f", ""), (None, "http://g", "same"), (None, "http://h", "alone"),
        (7, "http://i", "é\r\n\r\nWARC/1.1\r\n" * 1000), (8, "http://j", "x" * 500_000), (-3, "http://k", "é"),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_round_trip_through_archives(spark):
    df = pages(spark).selectExpr("*", "page_id as keeper", "html as sha1").repartition(3)
    archives = warc.write_archives(df)
    found = warc.read_archives(archives).collect()
    assert not [r for r in found if r.gap] and len(found) == 11
    number = lambda u: None if u in (None, "<urn:page:none>") else int(u[10:-1])
    got = sorted(
        ((number(r.record_id), r.record_type, number(r.refers_to), r.payload_bytes, r.payload and bytes(r.payload)) for r in found), key=str
    )
    wanted = []
    for r in pages(spark).collect():
        text = (r.html or "").encode()
        keeper = {b"same": 9, b"": 5}.get(text)
        revisit = keeper is not None and r.page_id != keeper
        wanted.append((r.page_id, "revisit" if revisit else "response", keeper if revisit else None, len(text), None if revisit or not text else text))
    assert sorted(((*g[:4], g[4] or None) for g in got), key=str) == sorted(wanted, key=str)
    assert {r.payload_digest for r in found if r.payload_bytes == 4} == {warc.base32_sha1(b"same")}
    assert {r.target_uri for r in found} >= {"http://a/%20b%0D%0AWARC-Type:%20x", None}


def test_smaller_payloads_are_all_responses_and_empty_table(spark):
    archives = warc.write_archives(pages(spark), least=5)
    assert {r.record_type for r in warc.read_archives(archives, payloads=False).collect()} == {"response"}
    none = warc.write_archives(pages(spark).limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_damaged_archive_is_read_by_spark(spark, tmp_path):
    packed = [gzip.compress(r) for r in members(6)]
    packed[3] = packed[3][: len(packed[3]) // 2]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),), (f"file:{tmp_path}/empty.warc.gz",), (None,)], "path string")
    found = warc.read_archives(paths).collect()
    assert sorted(int(r.record_id[10:-1]) for r in found if not r.gap) == [0, 1, 2, 4, 5]
    assert len([r for r in found if r.gap]) == 1


def test_query_has_sql():
    assert "op9_warc" in QUERIES and "op9_warc" in ORACLES


def test_records_that_share_a_member_with_a_damaged_one():
    records = members(6, seed=4)
    records[3] = records[3][:-6] + bytes([records[3][-6] ^ 1]) + records[3][-5:]
    before, shared, behind = gzip.compress(members(1)[0]), gzip.compress(b"".join(records)), gzip.compress(members(9)[8])
    found = read(before + shared + behind)
    assert ids(found) == [0, 0, 1, 2, 4, 5, 8]
    (gap,) = [r for r in found if r["gap"]]
    assert (gap["start"], gap["end"]) == (len(before), len(before + shared)) and gap["gap"] == "payload digest differs"
    assert (gap["inner_start"], gap["inner_end"]) == (sum(map(len, records[:3])), sum(map(len, records[:4])))


def test_records_of_a_member_that_is_cut_off_or_corrupt():
    records = members(6, seed=5)
    shared = gzip.compress(b"".join(records))
    found = read(shared[:-40])
    assert ids(found) == [0, 1, 2, 3, 4] and found[-1]["gap"] == "member is cut off"
    assert (found[-1]["start"], found[-1]["end"]) == (0, len(shared) - 40) and found[0]["end"] == 0
    alone = gzip.compress(members(8)[7])
    hurt = bytearray(shared)
    hurt[-5] ^= 0xFF  # the checksum
    assert ids(read(bytes(hurt) + alone)) == [0, 1, 2, 3, 4, 7]
    revisit = warc.page_record(3, None, b"x" * 50, 1)
    several = gzip.compress(records[0] + revisit + records[1] + records[2])
    hurt = bytearray(several)
    hurt[-5] ^= 0xFF
    assert ids(read(bytes(hurt))) == [0, 1]  # no digest confirms a revisit there
    assert ids(read(several[:-3])) == [0, 3, 1]


def test_header_of_several_megabytes(spark):
    url = "http://h/" + "é " * 1_500_000
    df = spark.createDataFrame([(1, url, "a"), (2, "http://b", "b")], PAGES)
    found = warc.read_archives(warc.write_archives(df)).collect()
    assert not [r for r in found if r.gap] and sorted(len(r.target_uri) for r in found) == [8, 9 + 4 * 1_500_000]
    record = warc.page_record(1, url, b"x", None)
    assert ids(read(record)) == [1]
