"""Converter from the legacy ARC format (versions 1 and 2) to WARC.

An ARC file begins with a version block; each record is one header line, whose fields
depend on the version, and as many bytes as the line's last field declares.  The parser
goes by the declared lengths only, so payloads may hold anything, header-like lines too.
The converter synthesises what ARC lacks: record ids (name-based, so a task that runs again
writes the same id), ISO timestamps from the 14-digit archive dates, record types (an HTTP
message is a response, anything else a resource), payload digests and block lengths.

Payloads that occur more than once: of records with equal payloads of at least
``revisit_from`` bytes the one with the smallest page id is the response, the others become
revisits that refer to it and hold the HTTP header only.

Archives are gzip files written and read by Spark (any file system).  A task writes blocks of
records of about 8 MB and begins a new archive, with its own first record, every ``BLOCKS``
blocks, so that an archive stays near half a gigabyte whatever a task is dealt (a longer
record makes it longer); another task parses it as a stream, record by record.

Defined cases: spaces in the URL of an ARC header line belong to the URL and are
percent-encoded in the WARC record; an ARC line without a declared length, with too few fields
or with fewer bytes than declared ends the job with an error that says so; a null html is the empty payload, a null url becomes ``about:blank`` and
characters that a header line cannot hold are percent-encoded; rows without page_id take
no part; rows that repeat a page id get a record each; an empty table gives empty archives
and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import saved, scratch, slices, table, utf8
from parcelwise.operators.windows import spread_join

# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
RECORD = "page_id long, url string, ip string, stamp string, mime string, status string, http binary, payload binary, digest string"
CRLF = b"\r\n"
BLOCK_BYTES = 8 << 20
BLOCKS = 64          # blocks of records in one archive
WARC_INPUT = ["payload", "http", "page_id", "url", "ip", "stamp", "mime", "digest", "refers_to", "refers_url", "refers_stamp"]


# --- ARC ---

def arc_header(version: int, url: str, ip: str, stamp: str, mime: str, length: int, status: str = "200", name: str = "-") -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": stamp, "Content-type": mime, "Result-code": status,
              "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(length)}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode()


def arc_version_block(version: int, name: str, stamp: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", stamp, "text/plain", len(body), name=name) + b"\n" + body


def safe_url(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else "about:blank"


def _or_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches; one None where there are none."""
    empty = True
    for b in batches:
        empty = False
        yield b
    if empty:
        yield None


def _to_arc(stamp: str, ip: str, block_bytes: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        for i, b in enumerate(_or_none(slices(batches, 2, block_bytes))):
            name = f"part-{part}-{i // blocks}.arc.gz"
            rows = [] if i % blocks else [arc_version_block(version, name, stamp)]
            if b is None:
                yield table({"value": (rows, pa.binary())})
                return
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                body = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\n"
                        f"Content-Length: {len(html)}\r\n\r\n").encode() + html
                rows.append(arc_header(version, safe_url(url), ip, stamp, "text/html", len(body), name=name) + b"\n" + body)
            yield table({"value": ([b"\n".join(rows)], pa.binary())})
    return run


def write_arc(pages: DataFrame, target: str, stamp: str = "20240101000000", ip: str = "0.0.0.0",
              block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> None:
    """Pages as gzip ARC files, versions 1 and 2 in turn."""
    (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
     .where("page_id is not null").mapInArrow(_to_arc(stamp, ip, block_bytes, blocks), "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", blocks).option("compression", "gzip").text(target))


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block."""
    fields: list[str] | None = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        # the URL is the first field and the only one that can hold spaces
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1 if fields else -1)
        if not values[-1].isdigit():
            raise ValueError("an ARC header line does not end with a length")
        length = int(values[-1])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError("an ARC record ends before its declared length")
        if fields is None:
            version, columns = body.split(b"\n")[:2]
            fields = columns.decode().split(" ")
            if fields != ARC_FIELDS.get(int(version.split(b" ")[0])):
                raise ValueError("unknown ARC version block")
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields, not {len(fields)}")
        yield dict(zip(fields, values)), body


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its empty line) and payload; no header for other bodies."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    cut = body.find(b"\r\n\r\n")
    return (body, b"") if cut < 0 else (body[:cut + 4], body[cut + 4:])


def header_value(block: bytes, name: bytes) -> str | None:
    for line in block.split(CRLF):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[io.BufferedIOBase]:
    for b in batches:
        for content in b.column(0):
            yield io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer()))), 1 << 20)


def _batched(rows: Iterator[tuple], schema: dict[str, pa.DataType], weigh) -> Iterator[pa.RecordBatch]:
    """Record batches of about 8 MB from a stream of tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weigh(row)
        if size > 8 << 20:
            yield table({n: (c, t) for (n, t), c in zip(schema.items(), zip(*held))})
            held, size = [], 0
    if held:
        yield table({n: (c, t) for (n, t), c in zip(schema.items(), zip(*held))})


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for stream in _files(batches):
            for f, body in parse_arc(stream):
                http, payload = http_parts(body)
                page = header_value(http, b"X-Page-Id")
                yield (int(page) if page else None, safe_url(f["URL"]) if " " in f["URL"] else f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"],
                       f.get("Result-code", "200"), http, payload, hashlib.sha256(payload).hexdigest())
    s, b = pa.string(), pa.binary()
    schema = {"page_id": pa.int64(), "url": s, "ip": s, "stamp": s, "mime": s, "status": s, "http": b, "payload": b, "digest": s}
    yield from _batched(rows(), schema, lambda r: len(r[7]))


def read_arc(spark: SparkSession, source: str) -> DataFrame:
    """One row per ARC record."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source).select("content").mapInArrow(_from_arc, RECORD)


# --- WARC ---

def iso(stamp: str) -> str:
    s = stamp.ljust(14, "0")
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def record_id(url: str, stamp: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {stamp} {page}')}>"


def warc_record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}"] + [f"{k}: {v}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + CRLF.join(x.encode() for x in lines) + b"\r\n\r\n" + block


def _to_warc(block_bytes: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        info = b"software: arc-to-warc\r\nformat: WARC File Format 1.1\r\n"
        for i, b in enumerate(_or_none(slices(batches, 0, block_bytes))):
            rows = []
            if i % blocks == 0:
                name = f"part-{TaskContext.get().partitionId()}-{i // blocks}.warc.gz"
                rows.append(warc_record("warcinfo", {"WARC-Record-ID": record_id(name, "", None), "WARC-Date": "1970-01-01T00:00:00Z",
                                                     "WARC-Filename": name, "Content-Type": "application/warc-fields"}, info))
            if b is None:
                yield table({"value": (rows, pa.binary())})
                return
            for r in b.to_pylist():
                revisit = r["refers_to"] is not None
                kind = "revisit" if revisit else "response" if r["http"] else "resource"
                rows.append(warc_record(kind, {
                    "WARC-Record-ID": record_id(r["url"], r["stamp"], r["page_id"]), "WARC-Date": iso(r["stamp"]), "WARC-Target-URI": r["url"],
                    "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha256:{r['digest']}", "X-Page-Id": r["page_id"],
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                    "WARC-Refers-To": record_id(r["refers_url"], r["refers_stamp"], r["refers_to"]) if revisit else None,
                    "X-Refers-To-Page-Id": r["refers_to"],
                    "Content-Type": "application/http; msgtype=response" if r["http"] else r["mime"],
                }, r["http"] if revisit else r["http"] + r["payload"]))
            yield table({"value": ([(CRLF + CRLF).join(rows)], pa.binary())})
    return run


def convert(spark: SparkSession, source: str, target: str, revisit_from: int = 100,
            block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> None:
    """ARC files under ``source`` to WARC files under ``target``."""
    index = saved(read_arc(spark, source).select("page_id", "url", "stamp", "digest", F.octet_length("payload").alias("size")), "arc_index")
    large = index.where((F.col("size") >= revisit_from) & F.col("page_id").isNotNull())
    firsts = (large.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url", "stamp")).alias("first")).where("n > 1")
              .select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"),
                      F.col("first.stamp").alias("refers_stamp")))
    revisits = saved(spread_join(large, firsts, "digest", ["page_id"]).where("page_id <> refers_to")
                     .select("page_id", "digest", "refers_to", "refers_url", "refers_stamp").distinct(), "revisits")
    (read_arc(spark, source).join(revisits, ["page_id", "digest"], "left").select(*WARC_INPUT).mapInArrow(_to_warc(block_bytes, blocks), "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", blocks)
     .option("compression", "gzip").text(target))


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record does not begin with its version")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record ends before its declared length")
        yield fields, block


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for stream in _files(batches):
            for f, block in parse_warc(stream):
                kind = f["warc-type"]
                if kind == "warcinfo":
                    continue
                http, payload = http_parts(block)
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                if kind == "revisit":
                    size = int(header_value(http, b"Content-Length") or 0)
                else:
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {f['warc-record-id']} does not have its digest")
                number = lambda k: int(f[k]) if k in f else None
                yield (number("x-page-id"), f["warc-record-id"], f["warc-target-uri"], f["warc-date"], kind, size, digest,
                       number("x-refers-to-page-id"), f.get("warc-refers-to"), payload)
    s, n, b = pa.string(), pa.int64(), pa.binary()
    schema = {"page_id": n, "record_id": s, "url": s, "date": s, "record_type": s, "payload_bytes": n, "payload_digest": s,
              "refers_to": n, "refers_to_id": s, "payload": b}
    yield from _batched(rows(), schema, lambda r: len(r[9]))


def read_warc(spark: SparkSession, source: str) -> DataFrame:
    """One row per WARC record, the payload included (none for revisits)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source).select("content").mapInArrow(
        _from_warc, "page_id long, record_id string, url string, date string, record_type string, payload_bytes long, "
                    "payload_digest string, refers_to long, refers_to_id string, payload binary")


def warc_round_trip(pages: DataFrame, revisit_from: int = 100, **cuts: int) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, **cuts)
    convert(spark, arc, warc, revisit_from, **cuts)
    return read_warc(spark, warc)
