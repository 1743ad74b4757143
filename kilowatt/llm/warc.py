"""WARC archives: writing, reading back, and reassembly of segmented records.

``write_archives`` writes one record for each page: a ``response`` whose HTTP
body is sent in chunks, or a ``revisit`` of the page with the smallest id
among those with an equal payload of at least ``REVISIT_BYTES`` bytes. A
record whose block is longer than ``SEGMENT_BYTES`` is cut into segments: the
record itself with segment number 1, then ``continuation`` records that name
it as their origin.

``read_archives`` parses the files by each record's Content-Length, groups
continuations by origin id, orders them by segment number, checks that no
segment is missing and that the length is the one the last segment states,
and takes the chunked framing off. Only segmented records are shuffled. A
segment is bounded, so an archive of ``RECORDS_PER_FILE`` records is too, and
is read by one task.

Segments and chunks end at a character's end, so every record is text and the
archives are written with Spark's text writer (a record ends with an empty
line; the writer's line separator is its second half), compressed with gzip.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed, look_up

REVISIT_BYTES = 100
SEGMENT_BYTES = 1 << 14
CHUNK_BYTES = 1 << 12
RECORDS_PER_FILE = 2_000

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = b"Transfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """data in pieces of up to ``size`` bytes that end with a character."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop]
        at = stop


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _pieces(payload, CHUNK_BYTES)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body (extensions and trailers are passed
    over); None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at:at + size])
        at += size + 2
        if body[at - 2:at] != b"\r\n":
            return None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; None if it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r\n]*chunked", head) else body


def _record(fields: list[tuple[str, str | None]], block: bytes) -> str:
    """A record without the last line end (the writer adds it)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}\r\n"


def _records(page: str, url: str | None, html: str, digest: str, first: str | None) -> Iterator[str]:
    """The records of one page; ``first``: the page that a revisit refers to."""
    name = f"<urn:page:{page}:{digest}>"
    uri = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", uri or None), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}:{digest}>")],
                      HTTP_HEAD + b"\r\n")
        return
    block = HTTP_HEAD + CHUNKED + chunked(html.encode())
    parts = list(_pieces(block, SEGMENT_BYTES))
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = str(len(block)) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name),
                       ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of the pages in the folder ``path``; an empty table writes none.

    Null html is an empty payload, a null url gives no target. A null id is
    written as ``null``; among equal payloads it is later than any other id, and
    without another id such pages are all responses, as are repeated rows of the
    response's id. Other columns are not read.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = own.where(F.octet_length("html") >= REVISIT_BYTES).select("id", "digest")
    same = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    told = look_up(own, checkpointed(same), "digest", "left")
    told = told.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("page"), "url", "html", "digest",
                       F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(batch.column(k).slice(at, 256).to_pylist() for k in range(5)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in _records(*row)], pa.string())], names=["value"])

    told.mapInArrow(build, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of an archive file,
    plain or compressed with gzip (as one member or a member for each record)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("an archive ends within a record's header")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}
        size = int(fields["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) < size:
            raise ValueError("an archive ends within a record's block")
        yield fields, block
        at = end + 4 + size
        while data[at:at + 2] == b"\r\n":
            at += 2


FIELDS = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, number int, total long, block binary"
_NAMES = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")


def scan(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """The records of the archives in ``path``, as they are; record_id of a
    continuation is its origin's. segments: only those cut into segments
    (True) or only whole records (False)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.string()] * 5, pa.int32(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for fields, block in parse(batch.column(0)[k].as_py()):
                    number = fields.get("warc-segment-number")
                    if segments is not None and segments != (number is not None):
                        continue
                    row = [fields.get(n) for n in _NAMES]
                    row[0] = fields.get("warc-segment-origin-id", row[0])
                    total = fields.get("warc-segment-total-length")
                    rows.append((*row, number and int(number), total and int(total), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target_uri, payload_digest, refers_to, payload
    binary, valid) of each response and revisit in the archives of ``path``.

    payload: of a response, unchunked; null for a revisit, and for a response
    whose segments are not whole or whose framing is broken, which is not
    valid. Repeated records are returned as often as they are there.
    """
    kept = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to"]
    whole = scan(spark, path, segments=False).where("record_type IN ('response', 'revisit')").select(
        *kept, F.array("block").alias("blocks"), F.lit(True).alias("valid"))
    parts = scan(spark, path, segments=True)
    # a record's segments are one page: they fit a row, as the page did
    heads = F.collect_list(F.when(F.col("number") == 1, F.struct(*kept[1:])))
    met = parts.groupBy("record_id").agg(
        heads.alias("heads"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = met.select("record_id", F.explode("heads").alias("head"), F.transform("parts", lambda p: p["block"]).alias("blocks"),
                        F.coalesce((F.col("total") == length) & in_order, F.lit(False)).alias("valid"))
    joined = joined.select("record_id", *[F.col(f"head.{c}").alias(c) for c in kept[1:]], "blocks", "valid")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads = [payload_of(b"".join(blocks)) if ok and kind == "response" else None
                            for kind, blocks, ok in zip(*(part.column(c).to_pylist() for c in ("record_type", "blocks", "valid")), strict=True)]
                ok = [p is not None or kind == "revisit" for p, kind in zip(payloads, part.column("record_type").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(payloads, pa.binary()), pa.array(ok)], names=[*kept, "payload", "valid"])

    schema = ", ".join(f"{c} string" for c in kept) + ", payload binary, valid boolean"
    return whole.unionByName(joined).mapInArrow(decode, schema)


def captures(records: DataFrame) -> DataFrame:
    """Of ``read_archives``: (page string, payload_bytes, payload_digest hex,
    record_type, refers_to page) of each page. A revisit's payload is that of
    the record it refers to; digests and lengths are taken from the payload
    itself, not from the header."""
    page = F.nullif(F.regexp_extract("record_id", r"^<urn:page:(.*):[0-9a-f]{64}>$", 1), F.lit("null"))
    to = F.regexp_extract("refers_to", r"^<urn:page:(.*):[0-9a-f]{64}>$", 1)
    found = checkpointed(records.select(
        "record_id", "record_type", "refers_to", page.alias("page"), to.alias("to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")))
    response = found.where("record_type = 'response'")
    original = response.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisit = look_up(found.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest"), checkpointed(original), "refers_to", "left")
    columns = ["page", "payload_bytes", "payload_digest", "record_type"]
    return response.select(*columns, F.lit(None).cast("string").alias("refers_to")).unionByName(revisit.select(*columns, F.col("to").alias("refers_to")))
