"""The archive round trip and the salvage of damaged archives."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from riskloom.llm import warc


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def some(n, rng):
    return [(i, warc.record(i, f"http://x/{i}", bytes(rng.choices(b"abc <>\r\n\x1f\x8b\x08WARC/1.", k=rng.randint(0, 400))))) for i in range(n)]


def read(data):
    records, gaps = [], []
    for offset, length, rec, reason in warc.salvage(data):
        (records if rec else gaps).append((offset, length, rec or reason))
    return records, gaps


def test_plain_and_member_archives():
    rng = random.Random(0)
    recs = some(30, rng)
    for data in (b"".join(r for _, r in recs), b"".join(warc.member(r) for _, r in recs), b"".join(warc.member(r) if i % 2 else r for i, r in recs)):
        records, gaps = read(data)
        assert [int(r[2]["page_id"]) for r in records] == [i for i, _ in recs] and not gaps
        assert sum(r[1] for r in records) == len(data)
    assert gzip.decompress(b"".join(warc.member(r) for _, r in recs)) == b"".join(r for _, r in recs)
    assert read(b"") == ([], [])


def test_damage_is_quarantined_and_later_records_recovered():
    rng = random.Random(1)
    recs = some(12, rng)
    for make in (warc.member, bytes):
        parts = [make(r) for _, r in recs]
        starts = [sum(map(len, parts[:k])) for k in range(13)]
        for k in range(12):
            data = bytearray(b"".join(parts))
            at = starts[k] + (len(parts[k]) // 2 if make is warc.member else len(parts[k]) - 10)  # a plain record's header has no digest
            data[at] ^= 0x55
            records, gaps = read(bytes(data))
            assert {int(r[2]["page_id"]) for r in records} >= {i for i, _ in recs if i != k}
            assert gaps and gaps[0][0] == starts[k] and all(starts[k] <= g[0] and g[0] + g[1] <= starts[k + 1] for g in gaps)
        data = b"".join(parts[:5]) + b"junk between" + b"".join(parts[5:])[:-7]
        records, gaps = read(data)
        assert {int(r[2]["page_id"]) for r in records} >= set(range(11))
        assert gaps[0][:2] == (starts[5], 12) and gaps[-1][0] + gaps[-1][1] == len(data)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3))
def test_any_bytes_are_covered(junk, n):
    recs = [warc.member(warc.record(i, None, b"payload")) for i in range(n)]
    data = junk.join([b"", *recs, b""])
    found = list(warc.salvage(data))
    assert sum(1 for f in found if f[2]) == n
    covered = bytearray(len(data))
    for offset, length, _, _ in found:
        covered[offset : offset + length] = b"\1" * length
    assert all(c or data[i] in b"\x00\r\n" for i, c in enumerate(covered))


def test_a_cut_first_member_of_a_pair():
    one, two = warc.member(warc.record(1, None, b"x" * 5000)), warc.member(warc.record(2, None, b"y"))
    records, gaps = read(one[:40] + two)
    assert [r[2]["page_id"] for r in records] == ["2"] and gaps[0][:2] == (0, 40)


def test_pages_round_trip(spark):
    html = ["<p>é漢</p>", "<p>é漢</p>", "", None, "one", "WARC/1.1\r\n\r\n", "one", "z" * 300_000]
    pages = [(i, f"http://a/{i}\n b", h, "r") for i, h in enumerate(html)] + [(4, "http://a/4", "one", "r"), (None, None, "one", "r")]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string, refers_to string").repartition(3)).collect()
    assert all(r.reason is None for r in got)
    want = []
    for i, _, h, _ in pages:
        top = max(j for j, _, g, _ in pages if j is not None and (g or "") == (h or ""))
        want.append(("" if i is None else str(i), len((h or "").encode()), sha(h or ""), "response" if i == top else "revisit", None if i == top else str(top)))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    small = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string, refers_to string"), least_bytes=5).collect()
    assert {r.record_type for r in small if r.payload_bytes < 5} == {"response"} and sum(r.record_type == "revisit" for r in small) == 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty).count() == 0


def test_a_failed_member_gives_its_records_before_the_damage():
    rng = random.Random(4)
    recs = [(i, warc.record(i, "u", rng.randbytes(3000))) for i in range(40)]
    whole, after = warc.member(b"".join(r for _, r in recs)), warc.member(warc.record(99, None, b"z"))
    flipped = bytearray(whole)
    flipped[-5] ^= 1  # the checksum: all records are good
    late = bytearray(whole)
    late[len(whole) * 3 // 4] ^= 0x55
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    plain = bytearray(stored.compress(b"".join(r for _, r in recs)) + stored.flush())
    plain[-5] ^= 1
    for data, least in ((flipped, 40), (late, 28), (whole[: len(whole) * 3 // 4], 28), (whole[:-8], 40), (plain, 40)):
        records, gaps = read(bytes(data) + after)
        ids = [int(r[2]["page_id"]) for r in records]
        assert ids[:least] == list(range(least)) and ids[-1] == 99 and len(set(ids)) == len(ids)
        assert gaps[0][0] == 0 and all(g[1] > 0 and g[0] + g[1] <= len(data) for g in gaps)


def test_gaps_inside_a_member_say_which_bytes():
    rng = random.Random(6)
    recs = [warc.record(i, "u", rng.randbytes(300)) for i in range(50)]
    starts = [sum(map(len, recs[:k])) for k in range(51)]
    inner = bytearray(b"".join(recs))
    for k in (7, 8, 30):
        inner[starts[k] + len(recs[k]) - 20] ^= 1
    data = warc.member(bytes(inner))
    records, gaps = read(data)
    assert [int(r[2]["page_id"]) for r in records] == [i for i in range(50) if i not in (7, 8, 30)]
    assert [g[2].split(": ")[1] for g in gaps] == [f"{starts[9] - starts[7]} bytes from {starts[7]} on in the member", f"{starts[31] - starts[30]} bytes from {starts[30]} on in the member"]


def test_a_member_that_inflates_too_far(monkeypatch):
    monkeypatch.setattr(warc, "MOST_INFLATED", 50_000)
    first = warc.record(1, "u", b"good")
    bomb, after = warc.member(first + b"\0" * 30_000_000), warc.member(warc.record(2, "u", b"later"))
    records, gaps = read(bomb + after)
    assert [r[2]["page_id"] for r in records] == ["1", "2"] and "inflates" in gaps[0][2]


def test_a_page_that_does_not_come_back_is_an_error(spark, monkeypatch):
    from riskloom.llm import queries

    lost = spark.createDataFrame([(None, "member cut short")], "record_type string, reason string").selectExpr("*", "'1' AS page_id", "1L AS payload_bytes", "'x' AS payload_digest", "'2' AS refers_to")
    monkeypatch.setattr(warc, "archive_pages", lambda *a, **k: lost)
    with pytest.raises(Exception, match="gap"):
        queries.op1_warc(spark, "/root/testdata/sf0.001").collect()


def test_headers_of_any_length(spark):
    fixed = len(warc.record(1, "", b"p").partition(b"\r\n\r\n")[0])
    for n in (100_000, *range(65_530 - fixed, 65_542 - fixed)):
        data = warc.record(1, "u" * n, b"p") + warc.record(2, None, b"q")
        assert [(r[2]["page_id"], r[2]["uri"]) for r in read(data)[0]] == [("1", "u" * n), ("2", None)] and not read(data)[1]
    pages = [(1, "data:," + "x" * 100_000, "one"), (2, " " * 30_000, "two"), (3, "http://a", "one")]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, len(r.uri)) for r in got) == [("1", "revisit", 100_006), ("2", "response", 90_000), ("3", "response", 8)]
    read(b"WARC/1." * 50_000 + b"\r\n\r\n")  # no quadratic search


def test_payloads_and_damaged_files_through_spark(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50, None) for i in range(50)], "page_id long, url string, html string, refers_to long").repartition(1)
    warc.write_archive(df, f"file://{tmp_path}/a", "page_id", "url", "html", "refers_to", bundle=2000)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 3 and all(gzip.decompress(f.read_bytes()) for f in files)
    (tmp_path / "b").mkdir()
    for k, f in enumerate(files):
        raw = bytearray(f.read_bytes())
        if k == 1:
            raw[60] ^= 1
        (tmp_path / "b" / f.name).write_bytes(raw)
    got = warc.read_archive(spark, f"file://{tmp_path}/b").collect()
    records, gaps = [r for r in got if r.record_type], [r for r in got if not r.record_type]
    assert len(records) == 49 and len(gaps) == 1 and gaps[0].length > 0 and gaps[0].archive.endswith(files[1].name)
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 50 for r in records)
