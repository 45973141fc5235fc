import gzip
import hashlib
import io
import uuid

import pytest

from leafmill.llm import warc
from leafmill.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string"


def there(spark):
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


def brute(pages, min_bytes=1000):
    groups = {}
    for p, _, h in pages:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(b) >= min_bytes and top is not None and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def pages():
    long = "é<p>line\r\n\r\n</p>" * 20_000
    rows = [(i, f"http://a.example/{i}", "x" * 1000 if i % 3 else f"page {i}\r\n\r\n0\r\n\r\n") for i in range(300)]
    rows += [(400, None, None), (401, "http://b.example/ \r\nX-Page-ID: 9", ""), (402, "u", "y" * 999), (403, "u", "y" * 999)]
    rows += [(500, "u", long), (501, "u", long), (502, "u", long + "!"), (502, "u", long + "!"), (None, "u", long), (None, "u", "z" * 2000)]
    return rows + [(600, "u", "日本" * 500), (600, "u", "日本" * 500), (599, "u", "日本" * 500)]


def test_round_trip(spark):
    rows, folder = pages(), there(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "page_id as size", "url as digest", "1 as _salt", "2 as type")
    warc.write_archives(df, folder, file_records=40)
    back = warc.read_archives(spark, folder)
    got = back.collect()
    assert not [r.problem for r in got if r.problem]
    want = {(p, (h or "").encode()) for p, _, h in rows}
    assert {(r.page_id, bytes(r.payload)) for r in got if r.type == "response"} <= want
    assert sorted((tuple(r) for r in warc.resolved(back).collect()), key=str) == brute(rows)
    assert {r.uri for r in got if r.page_id == 401} == {"http://b.example/%20%0D%0AX-Page-ID:%209"}


def test_small_segments(spark):
    rows, folder = pages(), there(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, segment_bytes=500, file_records=7)
    assert sorted((tuple(r) for r in warc.resolved(warc.read_archives(spark, folder)).collect()), key=str) == brute(rows)


def test_files_are_plain_warc(spark):
    folder = there(spark)
    warc.write_archives(spark.createDataFrame([(1, "http://a.example/", "h" * 150)], SCHEMA), folder, segment_bytes=200)
    files = spark.read.format("binaryFile").load(folder).select("content").collect()
    (data,) = [d for f in files if (d := gzip.decompress(f.content))]
    records = [r for r in data.split(b"WARC/1.1\r\n") if r]
    assert b"WARC-Segment-Number: 1\r\n" in records[0] and b"WARC-Type: continuation" in records[1]
    assert records[0].count(b"\r\n\r\n") >= 2 and records[1].endswith(b"0\r\n\r\n\r\n\r\n")
    assert b"WARC-Segment-Total-Length" in records[1] and b"WARC-Segment-Total-Length" not in records[0]


def test_empty_table(spark):
    folder = there(spark)
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.resolved(warc.read_archives(spark, folder)).count() == 0


def segment(number, block, total=None, origin="<o>", problem=None):
    return ("response" if number == 1 else "continuation", f"<{number}>", origin, number, total, "u", 1, "d", block, problem)


def test_faulty_segments_are_told():
    ok = list(warc.joined([segment(1, b"ab"), segment(2, b"c", 3), segment(1, b"x", 1, "<p>")]))
    assert [(r[8], r[9]) for r in ok] == [(b"abc", None), (b"x", None)]
    for parts, why in (
        ([segment(1, b"ab"), segment(3, b"c", 3)], "segments missing or repeated"),
        ([segment(2, b"c", 3)], "segments missing or repeated"),
        ([segment(1, b"ab"), segment(1, b"ab"), segment(2, b"c", 3)], "segments missing or repeated"),
        ([segment(1, b"ab"), segment(2, b"c", 4)], "total length differs"),
        ([segment(1, b"ab"), segment(2, b"c")], "total length differs"),
        ([segment(1, b"ab"), segment(2, b"c", 3, problem="cut")], "cut"),
    ):
        (r,) = warc.joined(parts)
        assert r[8] is None and r[9] == why


def test_chunks():
    for data in (b"", b"a", b"ab" * 10_000, b"0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n00\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nraw") == b"raw"


def test_cut_archives():
    whole = warc._record({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, b"12345") + b"\r\n\r\n"
    rows = list(warc.parsed(io.BytesIO(whole + whole[:-7]), False))
    assert [r[9] for r in rows] == [None, "block shorter than its length"]
    assert [r[9] for r in warc.parsed(io.BytesIO(whole + b"junk"), False)] == [None, "bytes that are no record"]
    assert list(warc.parsed(io.BytesIO(whole), True)) == []
    assert warc.sha1_hex(warc.sha1_label("00ff" * 10)) == "00ff" * 10 == warc.sha1_hex("sha1:" + "00FF" * 10)
