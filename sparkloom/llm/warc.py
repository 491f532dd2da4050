"""WARC archives: write, read back, reassemble segments and decode chunked transfer framing.

A record's block is an HTTP response whose body is framed in chunks; a block over SEGMENT bytes becomes a
first record and continuations (WARC-Segment-Number, WARC-Segment-Origin-ID, and on the last one
WARC-Segment-Total-Length). Payloads of MIN_REVISIT bytes or more that equal one with a smaller page_id are
revisit records without a body, which name that response; what a revisit's length, digest and page are is read from the
record that it names. A response that others revisit is named after its payload, any other after its place.

Archives are written by Spark's own text writer: two CRLF, which end every record, are its line separator, so
files are committed and retried as any table is and lie where spark.checkpoint.dir says. A file has at most
RECORDS_A_FILE records of at most SEGMENT bytes, which bounds what a reading task holds. Only continuation
records are shuffled, by their origin.

Spark's text writer compresses whole files and names them .txt.gz; archives of others, *.warc or *.warc.gz and also
gzipped by record, are read alike.

Defined cases: null html is an empty payload; a null page_id is kept as null and revisits any that is not; rows that
share id and payload are all responses, one record as often; an empty table gives an archive without records. A record
whose segments are not 1..n, or don't add up to the total length, or whose digest differs, and a revisit whose record
is missing or broken, has status `broken`, never a wrong payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, tidied

SEGMENT = 64 * 1024
CHUNK = 16 * 1024
RECORDS_A_FILE = 2000
MIN_REVISIT = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
WHOLE = "page_id long, record_type string, record string, refers string, payload_bytes long, payload_digest string, status string, payload binary"
PARSED = WHOLE + ", segment int, total long, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are dropped."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[line + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%s: %s\r\n" % f for f in [*fields, (b"Content-Length", b"%d" % len(block))])
    return VERSION + head + b"\r\n" + block


def records(page_id, url, html: bytes, digest: str, refers_to, name: str, segment: int = SEGMENT):
    """The WARC records of one page, without the CRLFs that end them."""
    uri = b"urn:sparkloom:%s" % name.encode()
    page = b"null" if page_id is None else b"%d" % page_id
    fields = [(b"WARC-Record-ID", b"<%s>" % uri), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"WARC-Page-ID", page), (b"WARC-Payload-Digest", b"sha256:" + digest.encode())]
    if url:
        fields.append((b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())))
    if refers_to is not None:
        more = [(b"WARC-Type", b"revisit"), (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<urn:sparkloom:%s>" % refers_to.encode()), (b"Content-Type", b"application/http; msgtype=response")]
        yield _record([*more, *fields], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html)
    fields.append((b"Content-Type", b"application/http; msgtype=response"))
    if len(block) <= segment:
        yield _record([(b"WARC-Type", b"response"), *fields], block)
        return
    yield _record([(b"WARC-Type", b"response"), *fields, (b"WARC-Segment-Number", b"1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        own = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<%s:%d>" % (uri, n)), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"WARC-Segment-Origin-ID", b"<%s>" % uri), (b"WARC-Segment-Number", b"%d" % n)]
        if at + segment >= len(block):
            own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(own, block[at : at + segment])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), digest, name (of a response that others revisit), refers_to (that name, of a revisit)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= MIN_REVISIT
    first = base.filter(long).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = cut(first.filter("n > 1 and first_id is not null").select(F.col("digest").alias("first_digest"), "first_id"))
    joined = base.join(first, base["digest"] == first["first_digest"], "left")
    named = F.concat(F.lit("payload:"), "digest")
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    has = F.col("first_id").isNotNull()
    return joined.select("page_id", "url", "html", "digest", F.when(has & own, named).alias("name"), F.when(has & ~own, named).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files below path."""

    def make(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, digest, name, refers_to in zip(*(batch.column(i) for i in range(6))):
                name, n = name.as_py() or f"record:{part}:{n}", n + 1
                for record in records(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py(), name, segment):
                    out.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = with_revisits(pages).mapInArrow(make, "record binary")
    writer = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(data: bytes):
    """(fields, block) of each record of a WARC file, gzipped whole or by record, or plain."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError("not a WARC record")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip()
        n = int(fields[b"content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _id(value: bytes | None):
    value = (value or b"").strip(b"<>").rpartition(b":")[2]
    return int(value) if re.fullmatch(rb"-?\d+", value) else None


def _whole(block: bytes, digest: str):
    try:
        payload = http_payload(block)
    except ValueError:
        return None, None, "broken"
    found = hashlib.sha256(payload).hexdigest()
    return payload, found, "ok" if not digest or digest == found else "broken"


KINDS = {"page_id": pa.int64(), "record_type": pa.string(), "record": pa.string(), "refers": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "status": pa.string(), "payload": pa.binary(), "segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}


def _rows(data: bytes, payloads: bool):
    """The responses, revisits and segments of a file; a segment goes by the id of its first record."""
    for f, block in parse(data):
        number, kind = f.get(b"warc-segment-number"), f[b"warc-type"].decode()
        digest = f.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
        row = dict.fromkeys(KINDS) | {"page_id": _id(f.get(b"warc-page-id")), "record_type": kind, "payload_digest": digest, "record": f[b"warc-record-id"].decode()}
        if number is not None:
            total = f.get(b"warc-segment-total-length")
            row |= {"record": f.get(b"warc-segment-origin-id", f[b"warc-record-id"]).decode(), "segment": int(number), "total": int(total) if total else None, "block": block}
        elif kind == "revisit":
            row |= {"refers": f.get(b"warc-refers-to", b"").decode()}
        elif kind == "response":
            payload, found, status = _whole(block, digest)
            row |= {"payload_bytes": None if payload is None else len(payload), "payload_digest": found, "status": status, "payload": payload if payloads and status == "ok" else None}
        else:
            continue
        yield row


def _reassemble(payloads: bool):
    def run(table: pa.Table) -> pa.Table:
        # a record that was written several times has each segment so often
        parts = list({r["segment"]: r for r in sorted(table.to_pylist(), key=lambda r: r["segment"])}.values())
        first, block = parts[0], b"".join(r["block"] for r in parts)
        good = [r["segment"] for r in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
        payload, found, status = _whole(block, first["payload_digest"]) if good else (None, None, "broken")
        row = first | {"payload_bytes": None if payload is None else len(payload), "payload_digest": found, "status": status, "payload": payload if payloads and status == "ok" else None}
        times = sum(r["segment"] == first["segment"] for r in table.select(["segment"]).to_pylist())
        return pa.Table.from_pylist([{k: row[k] for k in list(KINDS)[:8]}] * times, pa.schema(list(KINDS.items())[:8]))

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, status, payload: a row for each response or revisit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(path).select("content")

    def read(batches):
        schema = pa.schema(list(KINDS.items()))
        for batch in batches:
            for data in batch.column(0):
                out, held = [], 0
                for row in _rows(data.as_py(), payloads):
                    out.append(row)
                    held += len(row["payload"] or b"") + len(row["block"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    # read once, for whole records, segments and revisits
    parsed = cut(files.mapInArrow(tidied(read), PARSED))
    whole = parsed.filter("segment is null").select(*list(KINDS)[:8])
    pieces = parsed.filter("segment is not null").groupBy("record").applyInArrow(_reassemble(payloads), WHOLE)
    responses = whole.filter("record_type = 'response'").unionByName(pieces)
    named = responses.select("record", F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("digest"), "status").dropDuplicates(["record"])
    revisits = whole.filter("record_type = 'revisit'").select("page_id", "record_type", F.col("refers").alias("record"), "payload_digest").join(named, "record", "left")
    right = F.coalesce((F.col("status") == "ok") & ((F.col("payload_digest") == F.col("digest")) | (F.col("payload_digest") == "")), F.lit(False))
    revisits = revisits.select("page_id", "record_type", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"), F.when(right, "ok").otherwise("broken").alias("status"), F.lit(None).cast("binary").alias("payload"))
    return responses.select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "status", "payload").unionByName(revisits)


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write the archives below the shared folder and read them back."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path, payloads)
