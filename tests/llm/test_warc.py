"""WARC archives: exact round trips of odd payloads."""

import base64
import gzip
import hashlib

from rareboost.llm import warc


def expected(pages, least=0):
    body = [(p, (h or "").encode()) for p, _, h, *_ in pages]
    out = []
    for p, b in body:
        same = [q for q, c in body if c == b and q is not None]
        last = max(same, default=None)
        revisit = len(b) >= least and last is not None and p != last
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((p, len(b), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/", "<p>é𝄞</p>", "x"), (2, "http://b/\r\nX: y %", "<p>é𝄞</p>", "x"), (3, None, None, "x"), (4, "http://d/", "", "x"), (None, "http://e/", "<p>é𝄞</p>", "x"),
    (5, "http://f/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n", "x"), (6, "ü", "\r\n\r\n" * 5, "x"), (6, "ü", "\r\n\r\n" * 5, "x"),
    (7, "http://h/", "y" * 400_000, "x"), (None, None, "alone", "x"), (-3, "http://i/", "\0\x85 ", "x"), (8, "http://i/", "\0\x85 ", "x"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")
    for least in (0, 5):
        assert sorted(map(tuple, warc.round_trip(df, least=least).collect()), key=str) == expected(PAGES, least)
    assert warc.round_trip(df.where("false")).count() == 0


def test_captures_are_whole(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_warc(df, path, archive_bytes=20_000)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(PAGES)
    got = warc.captures(records, with_payload=True).collect()
    assert all(r["request"] is not None and r["metadata"] is not None for r in got)
    uris = {r["metadata"]["page_id"]: r["answer"]["uri"] for r in got if r["metadata"]["page_id"] is not None}
    assert uris == {p: u for p, u, *_ in PAGES if p is not None}
    long = [r["answer"]["payload"] for r in got if r["metadata"]["page_id"] == 7]
    assert bytes(long[0]) == b"y" * 400_000
    archives = list((tmp_path / "w").glob("*.gz"))
    assert len(archives) > 3 and all(gzip.open(a).read()[:8] in (b"WARC/1.1", b"") for a in archives)


def test_archives_of_one_member_a_record(spark, tmp_path):
    """The usual layout of archives: every record is a gzip member of its own, in a .warc.gz."""
    records = [
        warc._record(kind, f"urn:x:{k}", [("WARC-Target-URI", "http://a/")], block)
        for k, (kind, block) in enumerate([("warcinfo", b"software: x"), ("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"body" * 9000), ("request", b"GET / HTTP/1.1\r\n\r\n")])
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    (tmp_path / "notes.md").write_text("no archive")
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r["kind"] for r in got) == sorted(["warcinfo", "response", "request"] * 2)
    assert {r["payload_bytes"] for r in got if r["kind"] == "response"} == {36_000}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(records[1])[:-20])
    try:
        warc.read_records(spark, str(tmp_path)).collect()
        raise AssertionError("a cut archive was read without a word")
    except Exception as e:  # noqa: BLE001
        assert "ends early" in str(e)
