"""Web archives: exact round trips, reassembly from any order and files, and broken input."""

import glob
import gzip
import hashlib
import random

import pytest

from tracegauge.llm import warc
from tracegauge.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """Brute force: what the archives must hold for each row."""
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body]
        best = min(same, key=lambda p: (p is None, p or 0))
        kind = "revisit" if len(body) >= 100 and page != best else "response"
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), kind, best if kind == "revisit" else None))
    return sorted(out, key=str)


def rows_of(rnd):
    texts = ["x" * 99, "x" * 100, "é" * 50, "", None, "\r\n\r\nWARC/1.1\r\n" * 20, "ab \x00" * 40_000, "0\r\n\r\n" * 30]
    rows = [(i, f"http://a.example/{i}", rnd.choice(texts)) for i in range(60)]
    return rows + [(100, None, "<p>alone</p>" * 9), (101, "http://a.example/a b\r\nWARC-Type: x", "y" * 300), (-7, "u", "y" * 300), (None, "u", "y" * 300), (None, "u", "z" * 300)]


def test_round_trip(spark):
    rows = rows_of(random.Random(3))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' AS body", "1 AS row", "'d' AS digest")
    got = [tuple(r) for r in warc.archive_round_trip(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == plain(rows)


def test_payloads_come_back_from_small_segments(spark):
    rows = [r for r in rows_of(random.Random(4)) if r[0] is not None]
    path = scratch_path(spark, "test-archive")
    warc.write_pages(spark.createDataFrame(rows, SCHEMA), path, segment_bytes=500, chunk_bytes=64, file_bytes=1 << 20)
    found = warc.read_records(spark, path).collect()
    assert all(r.problem is None for r in found)
    bodies = {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"}
    names = {r.record_id: r.page_id for r in found}
    for page, url, html in rows:
        own = [r for r in found if r.page_id == page]
        assert len(own) == 1 and (own[0].url or "").count("\n") == 0
        assert bodies[page if page in bodies else names[own[0].refers_to]] == (html or "").encode()
    assert len(glob.glob(f"{path}/*.txt")) > 1


def test_repeated_rows(spark):
    rows = [(1, "u", "s" * 200)] * 3
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [(1, 200, "response", 0), (1, 200, "revisit", 1), (1, 200, "revisit", 1)]


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(spark, files, tmp_path):
    for i, data in enumerate(files):
        (tmp_path / f"{i}.warc").write_bytes(data)
    return {r.record_id: r for r in warc.read_records(spark, str(tmp_path)).collect()}


def segments(name, body, size=40):
    digest = hashlib.sha256(body).hexdigest()
    end = warc.END.encode()
    return [r + end for r in warc.page_records(name, 1, "u", digest, body, None, size, 16)]


def test_segments_in_any_order_and_files(spark, tmp_path):
    a, b = segments("urn:a", b"first body " * 20), segments("urn:b", b"second " * 30)
    mixed = a + b
    random.Random(1).shuffle(mixed)
    files = [b"".join(mixed[:5]), gzip.compress(mixed[5]) + gzip.compress(b"".join(mixed[6:]))]
    got = archive(spark, files, tmp_path)
    assert bytes(got["urn:a"].payload) == b"first body " * 20 and bytes(got["urn:b"].payload) == b"second " * 30
    assert got["urn:a"].problem is None


@pytest.mark.parametrize(
    "damage, problem",
    [
        (lambda s: s[:2] + s[3:], "segment is missing or repeated"),
        (lambda s: s + [s[2]], "segment is missing or repeated"),
        (lambda s: s[1:], "segment is missing or repeated"),
        (lambda s: s[:-1], "last segment is missing"),
        (lambda s: s[:-1] + [s[-1].replace(b"Total-Length: ", b"Total-Length: 9")], "total length differs"),
        (lambda s: [s[0].replace(b"sha256:", b"sha256:" + b"0" * 64 + b" ")[: s[0].find(b"sha256:") + 71] + s[0][s[0].find(b"sha256:") + 71 :], *s[1:]], "digest differs"),
        (lambda s: [*s[:-1], s[-1][:-6]], "cut off"),
    ],
)
def test_broken_records_are_named(spark, tmp_path, damage, problem):
    got = archive(spark, [b"".join(damage(segments("urn:a", b"first body " * 20)))], tmp_path)["urn:a"]
    assert got.payload is None and got.problem == problem


def test_file_without_records(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"no archive at all")
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert [r.problem for r in got] == ["no record at byte 0"]


def test_chunked_framing():
    rnd = random.Random(2)
    for _ in range(200):
        body = rnd.randbytes(rnd.randrange(300))
        assert warc.unchunked(warc.chunked(body, rnd.randrange(1, 50))) == body
    assert warc.unchunked(b"A;x=1\r\n0123456789\r\n0\r\nTrailer: y\r\n\r\n") == b"0123456789"
    for bad in (b"", b"zz\r\nab\r\n0\r\n\r\n", b"5\r\nabc", b"3\r\nabcXX0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.body_of(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab"
