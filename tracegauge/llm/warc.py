"""Web archive files (WARC 1.1): writing, and reading with reassembly of segmented records.

Writing. A page becomes a ``response`` record: an HTTP head and the body in chunked transfer framing. Of pages
with equal bodies of some size only the one with the smallest id is stored so; the others are ``revisit`` records
that name it. A block longer than ``segment_bytes`` is cut: the first piece is the record itself with segment
number 1, the others are ``continuation`` records with the record's id as their origin and the next numbers, and
the last one states the total length. Segments of one record may lie in any files. Files stay below a bound,
since each is read in one piece; records are written to storage by Spark's own text writer, whose line
separator is the empty line that ends a record.

Reading. Files are cut into records by their Content-Length. Whole records are decoded where they are; only
segments are shuffled: grouped by origin, put in order by number, checked for gaps and for the total length. A
record that fails a check is returned with its ``problem`` and without payload.

Defined results: a null or missing body is empty. A null id comes after all others. Rows with one id are records of
their own. A null url is left out, white space and control characters in one are percent-encoded. Very long bodies are
cut into segments like others; a body must fit in one row, as it did in the table. Files may be gzipped by
record. An empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm.common import scratch_path, stored

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smallest body that a revisit may stand for.
LEAST = 100


# --- framing ----------------------------------------------------------------------------------


def chunked(body: bytes, size: int) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body; chunk extensions and trailers are skipped. Raises ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = framed[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size expected")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        parts.append(framed[at : at + n])
        at += n + 2


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, empty, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not empty:
        raise ValueError("no HTTP response")
    framing = [v for k, v in fields(head) if k == "transfer-encoding"]
    return unchunked(body) if framing and framing[-1].lower().endswith("chunked") else body


def fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields of a header after its first line; folded lines are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return [(k.strip().lower(), v.strip()) for k, _, v in pairs]


def records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every record of a file. A record that the file's end cuts off has ``problem``, as has what
    is no record at all; the rest of such a file cannot be read."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        header = dict(fields(data[at:end])) if data.startswith(b"WARC/", at) and end >= 0 else {}
        if not header.get("content-length", "").isdigit():
            yield {"problem": f"no record at byte {at}"}, b""
            return
        n = int(header["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            header["problem"] = "cut off"
        yield header, block
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


# --- writing ----------------------------------------------------------------------------------


def record(kind: str, block: bytes, named: list[tuple[str, str | None]]) -> bytes:
    """One record without the empty line that ends it."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *named, ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head if v is not None)]) + b"\r\n\r\n" + block


def _safe(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def page_records(record_id: str, page_id: int | None, url: str | None, digest: str, body: bytes, original: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    named = [
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-ID", None if page_id is None else str(page_id)),
    ]
    http = ("Content-Type", "application/http;msgtype=response")
    if original is not None:
        yield record("revisit", HEAD, [*named, ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{original}>"), http])
        return
    block = HEAD + chunked(body, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", block, [*named, http])
        return
    for number, at in enumerate(range(0, len(block), segment_bytes), 1):
        piece, last = block[at : at + segment_bytes], at + segment_bytes >= len(block)
        segment = [("WARC-Segment-Number", str(number)), ("WARC-Segment-Total-Length", str(len(block)) if last else None)]
        if number == 1:
            yield record("response", piece, [*named, *segment, http])
        else:
            own = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {number}').urn}>"
            yield record("continuation", piece, [("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", f"<{record_id}>"), *segment])


def write_pages(pages: DataFrame, path: str, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, file_bytes: int = 32 << 20) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``. A file holds about ``file_bytes`` at most."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    # Written with their numbers: a table that is computed twice may number its rows differently.
    rows = stored(rows.withColumns({"digest": F.sha2("body", 256), "row": F.monotonically_increasing_id()}), "pages")
    repeats = F.octet_length("body") >= LEAST
    # Ids and digests alone decide which row is stored, summed up within tasks first.
    first = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    narrow = rows.filter(repeats).select("digest", first.alias("first"))
    groups = stored(narrow.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n")).filter("n > 1"), "same-payload")
    groups = groups.select(F.col("digest").alias("same"), F.col("first.row").alias("original_row"), F.col("first.page_id").alias("original_page"))
    # Small bodies match nothing; keys of their own keep them from meeting in one task.
    joined = rows.withColumn("key", F.when(repeats, F.col("digest")).otherwise(F.col("row").cast("string"))).join(groups, F.col("key") == F.col("same"), "left")
    is_copy = F.col("original_row").isNotNull() & (F.col("original_row") != F.col("row"))
    name = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"))
    out = joined.select(
        name(F.col("page_id"), F.col("row")).alias("record_id"),
        "page_id",
        "url",
        "digest",
        F.when(~is_copy, F.col("body")).alias("body"),
        F.when(is_copy, name(F.col("original_page"), F.col("original_row"))).alias("original"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack: list[bytes] = []
        size = 0
        for batch in batches:
            for record_id, page_id, url, digest, body, original in zip(*(c.to_pylist() for c in batch.columns)):
                for one in page_records(record_id, page_id, url, digest, body or b"", original, segment_bytes, chunk_bytes):
                    pack.append(one)
                    size += len(one)
                    if size >= PACK:
                        yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(pack)], pa.binary())], ["value"])
                        pack, size = [], 0
        if pack:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(pack)], pa.binary())], ["value"])

    packs = out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packs.write.option("lineSep", END).option("maxRecordsPerFile", max(1, file_bytes // PACK)).text(path)


#: Bytes of records that go through the writer as one row.
PACK = 1 << 20


# --- reading ----------------------------------------------------------------------------------

RECORD_SQL = (
    "record_id string, record_type string, page_id long, url string, refers_to string, stated_digest string, "
    "origin string, segment int, total long, block binary, payload binary, problem string"
)


def _record_row(header: dict, block: bytes) -> tuple:
    def named(key: str) -> str | None:
        return header[key].strip("<>") if key in header else None

    def number(key: str) -> int | None:
        return int(header[key]) if re.fullmatch(r"-?\d{1,18}", header.get(key, "")) else None

    kind, segment = header.get("warc-type"), number("warc-segment-number")
    payload, problem = None, header.get("problem")
    if segment is None and problem is None and kind == "response":
        payload, problem = decoded(block)
    digest = header.get("warc-payload-digest", "").partition(":")[2] or None
    origin = named("warc-segment-origin-id") if kind == "continuation" else named("warc-record-id")
    whole = segment is None
    return (
        named("warc-record-id"), kind, number("page-id"), header.get("warc-target-uri"), named("warc-refers-to"), digest,
        None if whole else origin, segment, number("warc-segment-total-length"), None if whole else block, payload, problem,
    )


def decoded(block: bytes) -> tuple[bytes | None, str | None]:
    try:
        return body_of(block), None
    except ValueError as e:
        return None, str(e)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for header, block in records(memoryview(data.as_buffer()).tobytes()):
                rows.append(_record_row(header, block))
                size += len(block)
                if size >= PACK:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in RECORD_SQL.split(", ")])


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def reassembled(segments: list[dict]) -> tuple[bytes | None, str | None]:
    """The block of one record from its segments, in any order."""
    segments = sorted(segments, key=lambda s: s["segment"])
    numbers = [s["segment"] for s in segments]
    if any(s["problem"] for s in segments):
        return None, "cut off"
    if numbers != list(range(1, len(numbers) + 1)):
        return None, "segment is missing or repeated"
    total = segments[-1]["total"]
    block = b"".join(s["block"] for s in segments)
    if total is None:
        return None, "last segment is missing"
    return (block, None) if total == len(block) else (None, "total length differs")


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for origin, segments in zip(batch.column(0).to_pylist(), batch.column(1)):
            segments = segments.as_py()
            block, problem = reassembled(segments)
            payload, problem = decoded(block) if problem is None else (None, problem)
            first = min(segments, key=lambda s: s["segment"])
            yield _batch([(origin, "response", first["page_id"], first["url"], None, first["stated_digest"], None, None, None, None, payload, problem)])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files below ``path``, segments put together: record_id, record_type, page_id, url, refers_to (a
    record id), stated_digest, payload (null for other types than response) and problem."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    rows = files.mapInArrow(_read_files, RECORD_SQL)
    columns = ["record_id", "record_type", "page_id", "url", "refers_to", "stated_digest", "payload", "problem"]
    whole = rows.filter("segment IS NULL").select(*columns)
    # One record is one row again, so a group is as large as one record.
    parts = F.collect_list(F.struct("segment", "total", "block", "page_id", "url", "stated_digest", "problem"))
    cut = rows.filter("segment IS NOT NULL").groupBy("origin").agg(parts.alias("segments"))
    joined = cut.mapInArrow(_reassemble, RECORD_SQL).select(*columns)
    found = whole.union(joined)
    differs = F.col("payload").isNotNull() & F.col("stated_digest").rlike("^[0-9a-f]{64}$") & (F.sha2("payload", 256) != F.col("stated_digest"))
    bad = F.coalesce(differs, F.lit(False))
    return found.withColumns({"payload": F.when(~bad, F.col("payload")), "problem": F.when(bad, "digest differs").otherwise(F.col("problem"))})


def resolved(found: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to (a page id) and problem. A revisit has size and
    digest of the record it names; that both agree on the digest is checked."""
    pages = found.filter(F.col("record_type").isin("response", "revisit"))
    rows = pages.select("record_id", "record_type", "page_id", "refers_to", "stated_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "problem")
    rows = stored(rows, "archive-records")
    named = stored(rows.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("named")).distinct(), "archive-named")
    # Only records that a revisit names take part, so a hot one is a single row on this side.
    originals = rows.filter("record_type = 'response'").join(named, F.col("record_id") == F.col("named"), "left_semi")
    originals = stored(originals.select(F.col("record_id").alias("original"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest")), "archive-originals")
    revisits = rows.filter("record_type = 'revisit'").join(originals, F.col("refers_to") == F.col("original"), "left")
    agrees = F.col("stated_digest").isNull() | (F.col("stated_digest") == F.col("original_digest"))
    of_revisits = revisits.select(
        "page_id",
        F.col("original_bytes").alias("payload_bytes"),
        F.col("original_digest").alias("payload_digest"),
        "record_type",
        F.col("original_page").alias("refers_to"),
        F.when(F.col("original").isNull(), "named record is missing").when(~agrees, "digest differs").otherwise(F.col("problem")).alias("problem"),
    )
    of_responses = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem")
    return of_responses.union(of_revisits)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back and report what they hold."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_pages(pages, path)
    return resolved(read_records(spark, path)).drop("problem")
