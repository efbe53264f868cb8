"""WARC archives of pages: written, read back, and assembled into captures.

Every page becomes three records in one archive: the request, the response (or,
for a payload that another page already carries, a revisit of it), and metadata
with the page's id and url. Request and metadata name the response record in
``WARC-Concurrent-To``.

Reading parses the records of each archive by their lengths and joins them
through these identifiers into one nested row per capture; a revisit takes the
payload's length and digest from the response it refers to.

Of pages with equal payloads (by SHA-1 and length) of at least ``least`` bytes
the one with the largest id is the response. Archives are gzip files of bounded
size in the shared folder, written by Spark's text sink; the record terminator
is its line separator.

Edge cases: a null payload is empty; null urls and ids are left out of the
record and come back null (a null id is never referred to while another id has
the payload); rows that repeat the largest id are responses each; payloads may
hold line breaks, headers or whole records; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.session import stage, staged_path, unstage

ARCHIVE_BYTES = 8 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, kind string, concurrent_to string, refers_to string, date string, uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, *, key: str, payload: str, least: int) -> DataFrame:
    """Pages with ``serial``, a number of the row, and ``original``: the id of the page that carries an equal payload, null where it is its own."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    # Numbered where the rows are read, ahead of every shuffle: a task that runs again gives them the same numbers.
    named = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url"), body.alias("payload"), F.monotonically_increasing_id().alias("serial"))
    named = named.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    keys = named.select("page_id", "sha", "n")
    # Only payloads that several pages carry; the planner broadcasts them by their measured size or splits a hot one.
    shared = stage(keys.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1").drop("c"))
    return named.join(shared, ["sha", "n"], "left").withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def _uri(url: str | None) -> str | None:
    """A url as one header line; what is no plain ASCII is percent-encoded."""
    return None if url is None else "".join(c if "!" <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _plain(uri: str) -> str:
    out, k, raw = bytearray(), 0, uri.encode()
    while k < len(raw):
        if raw[k] == 0x25:
            out.append(int(raw[k + 1 : k + 3], 16))
            k += 3
        else:
            out.append(raw[k])
            k += 1
    return out.decode()


def _transaction(row: dict) -> list[bytes]:
    urn = lambda role: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row['serial']}/{role}')}"
    uri, payload, main = _uri(row["url"]), row["payload"], urn("response")
    target = ("WARC-Target-URI", uri)
    digest = ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")
    kind = "application/http; msgtype="
    if row["original"] is None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END.encode()
        answer = _record("response", main, [target, digest, ("Content-Type", kind + "response")], head + payload)
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        refers = ("WARC-Refers-To", f"<urn:page:{row['original']}>")
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END.encode()
        answer = _record("revisit", main, [target, digest, profile, refers, ("Content-Type", kind + "response")], head)
    to = ("WARC-Concurrent-To", f"<{main}>")
    ask = f"GET {uri or '/'} HTTP/1.1".encode() + END.encode()
    request = _record("request", urn("request"), [target, to, ("Content-Type", kind + "request")], ask)
    fields = b"" if row["page_id"] is None else f"page-id: {row['page_id']}\r\n".encode()
    metadata = _record("metadata", urn("metadata"), [target, to, ("Content-Type", "application/warc-fields")], fields)
    return [request, answer, metadata]


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            records = [r for row in batch.slice(a, 500).to_pylist() for r in _transaction(row)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).cast(pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", payload: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of all pages to a new folder.

    ``pages`` is read from files; a frame that shuffles is staged first, so that its
    rows keep their numbers when a lost executor's tasks run again.
    """
    rows = with_originals(pages, key=key, payload=payload, least=least)
    size = pages.agg(F.sum(F.octet_length(payload) + F.lit(1500))).first()[0] or 0
    # Dealt by a serial, so that archives are of even size whatever the order of the pages.
    rows = rows.repartition(max(1, int(size // archive_bytes)), F.xxhash64("page_id", "serial"))
    rendered = rows.select("serial", "page_id", "url", "payload", "original").mapInArrow(_render, "value string")
    rendered.write.option("lineSep", END).option("compression", "gzip").text(path)


def _inflated(data: bytes) -> bytes:
    """All members of a gzip file; archives often hold one per record."""
    parts = []
    while data.strip(b"\0"):
        unzip = zlib.decompressobj(31)
        parts.append(unzip.decompress(data))
        if not unzip.eof:
            raise ValueError("the gzip stream ends early")
        data = unzip.unused_data
    return b"".join(parts)


def _parse(name: str, data: bytes) -> Iterator[dict]:
    """Records of one archive, by their lengths."""
    data = _inflated(data) if name.endswith(".gz") else data
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        start = end + 4
        block = data[start : start + int(head["Content-Length"])]
        at = start + len(block) + 4
        kind, bare = head["WARC-Type"], lambda k: head[k].strip("<>") if k in head else None
        row = {
            "record_id": bare("WARC-Record-ID"), "kind": kind, "concurrent_to": bare("WARC-Concurrent-To"), "refers_to": bare("WARC-Refers-To"),
            "date": head.get("WARC-Date"), "uri": _plain(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, "page_id": None,
            "payload_bytes": None, "payload_digest": None, "payload": None,
        }
        if kind == "response":
            payload = block[block.index(END.encode()) + 4 :]
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest32(payload)}
            if head.get("WARC-Payload-Digest", "").startswith("sha1:") and f"sha1:{row['payload_digest']}" != head["WARC-Payload-Digest"]:
                raise ValueError(f"{name}: payload of {row['record_id']} does not have its digest")
        elif kind == "revisit":
            row["payload_digest"] = head["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in head else None
        elif kind == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
            row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
        yield row


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = list(_parse(path.as_py(), content.as_py()))
                for a in range(0, len(rows), 1500):
                    part = rows[a : a + 1500]
                    yield pa.RecordBatch.from_pylist(part if with_payload else [r | {"payload": None} for r in part], SCHEMA)

    return run


SCHEMA = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("date", pa.string()),
    ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in a folder; without payloads these are digested and left behind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path)
    return files.select("path", "content").mapInArrow(_reader(with_payload), RECORD)


def captures(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata, joined through concurrent-to."""
    main = ["record_id", "kind", "date", "uri", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    answers = records.where("kind in ('response', 'revisit')").select(F.col("record_id").alias("id"), F.struct(*main).alias("answer"))
    requests = records.where("kind = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "uri", "date").alias("request"))
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "page_id").alias("metadata"))
    return answers.join(requests, "id", "left").join(metadata, "id", "left").drop("id")


def round_trip(pages: DataFrame, *, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Write all pages, read the archives, and return what the captures say of each page."""
    spark = pages.sparkSession
    path = staged_path(spark)
    write_warc(pages, path, key=key, payload=payload, least=least)
    # Archives are parsed once; captures join the narrow records three ways.
    records = stage(read_records(spark, path, with_payload=False).drop("payload"))
    found = stage(
        captures(records).select(
            F.col("metadata.page_id").alias("page_id"), "answer.payload_bytes", "answer.payload_digest", F.col("answer.kind").alias("record_type"),
            F.regexp_extract("answer.refers_to", r"^urn:page:(-?\d+)$", 1).alias("to"),
        )
    )
    unstage(records)
    found = found.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("to").cast("long"))).drop("to")
    originals = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("of"))
    out = found.join(originals, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "of"))
    return out.select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
