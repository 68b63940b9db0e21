"""WARC archives of pages: written with segmented, chunked records, read back by reassembling the segments.

A record whose block is longer than a segment is written as a first record and continuation records.  Reading groups
the segments by the first record's identifier, orders them by number, checks that none is missing and that the total
length is the one that the last segment states, and then decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, stored
from faintlabel.session import ship_package

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 512
#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hexadecimal digits are four base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def records_of(page: object, serial: int, url: str | None, payload: bytes, digest: str, refers_to: object, segment: int, chunk: int) -> list[bytes]:
    """The records of one page: a revisit, or a response in one or more segments."""
    name = f"urn:x-page:{'null' if page is None else page}:{serial}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"\s", "%20", url) if url else None)]
    payload_digest = ("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
        return [_record([*own, *common, payload_digest, ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, payload_digest, ("Content-Type", "application/http; msgtype=response")]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), *common, ("WARC-Segment-Origin-ID", f"<{name}>")]
        out.append(_record([*own, ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(pages: DataFrame, folder: str, least: int = 0, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html; null html: no bytes) as gzip-compressed archives.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response, the others
    are revisits.  Rows with a null page_id are responses, and so are repeated rows of a response.  A file holds at most
    ``per_file`` records of at most a segment each, so a reader's memory is bounded.
    """
    ship_package(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("_size", F.octet_length("payload"))
    first = rows.where((F.col("_size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stored(first.where("_n > 1").select("digest", "_first"), "first")
    rows = rows.join(first, "digest", "left")
    refers = F.when((F.col("_size") >= least) & (F.col("page_id") > F.col("_first")), F.col("_first"))
    rows = rows.select("page_id", F.monotonically_increasing_id().alias("serial"), "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [r for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in records_of(*row, segment, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while (at := data.find(VERSION, at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


RECORD = "record_id string, type string, origin string, segment int, total long, digest string, refers_to string, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder, a row each."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for f, block in parse_archive(zlib.decompress(batch.column("content")[0].as_py(), 31)):
                own = f["warc-record-id"].strip("<>")
                number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                digest = f.get("warc-payload-digest")
                rows.append((
                    own, f["warc-type"], f.get("warc-segment-origin-id", own).strip("<>"), int(number) if number else None, int(total) if total else None,
                    digest.partition(":")[2] if digest else None, f.get("warc-refers-to", "").strip("<>") or None, block,
                ))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: record_id, type, digest, refers_to, block and status.

    Records without a segment number stand for themselves.  The others are grouped by the first one's identifier; equal
    numbers count once.  status: ``ok``, ``missing`` (a number is not there, or the last one's total) or ``length`` (the
    total length differs); the block of such a record is null.
    """
    alone = records.where("segment is null and type <> 'continuation'").select("record_id", "type", "digest", "refers_to", "block", F.lit("ok").alias("status"))
    parts = records.where("segment is not null").groupBy("origin", "segment").agg(F.min_by(F.struct("type", "digest", "refers_to", "total", "block"), "record_id").alias("p"))
    whole = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "p.block"))).alias("_parts"),  # the segments of one record
        F.max("p.total").alias("_total"),
        F.min_by("p", "segment").alias("_first"),
    )
    numbers = F.transform("_parts", lambda x: x["segment"])
    block = F.aggregate("_parts", F.lit("").cast("binary"), lambda joined, x: F.concat(joined, x["block"]))
    whole = whole.withColumn("_there", (numbers == F.sequence(F.lit(1), F.size("_parts"))) & F.col("_total").isNotNull()).withColumn("_block", block)
    status = F.when(~F.col("_there"), "missing").when(F.octet_length("_block") != F.col("_total"), "length").otherwise("ok")
    whole = whole.withColumn("status", status)
    return alone.unionByName(
        whole.select(F.col("origin").alias("record_id"), F.col("_first.type").alias("type"), F.col("_first.digest").alias("digest"), F.col("_first.refers_to").alias("refers_to"), F.when(F.col("status") == "ok", F.col("_block")).alias("block"), "status")
    )


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if size < 0 or len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(part)
        at = end + 4 + size
    return None


def payloads(records: DataFrame) -> DataFrame:
    """record_id, type, digest, refers_to, status, payload and payload_sha1 of whole records.

    The block's HTTP header is parted from the body, chunked framing is undone.  A revisit has no payload; its
    payload_bytes are what its HTTP header states.  status ``framing``: no HTTP header, or broken chunks; ``digest``: the
    payload has another digest than the record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for kind, stated, block, status in zip(*[batch.column(c).to_pylist() for c in ("type", "digest", "block", "status")], strict=True):
                if block is None:
                    found.append((status, None, None, None))
                    continue
                head, gap, body = block.partition(b"\r\n\r\n")
                fields = dict(re.findall(rb"\r\n([^:\r]+):\s*([^\r]*)", head.lower()))
                if kind == "revisit":
                    found.append((status if gap else "framing", None, int(fields.get(b"content-length", b"0")), stated))
                    continue
                payload = (dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body) if gap else None
                if payload is None:
                    found.append(("framing", None, None, None))
                    continue
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                found.append((status if stated in (None, digest) else "digest", payload, len(payload), digest))
            kept = [batch.column(c) for c in ("record_id", "type", "refers_to")]
            made = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["record_id", "type", "refers_to", "status", "payload", "payload_bytes", "payload_digest"])

    given = records.select("record_id", "type", "refers_to", "digest", "block", "status")
    return given.mapInArrow(run, "record_id string, type string, refers_to string, status string, payload binary, payload_bytes long, payload_digest string")


def page_of(name: Column) -> Column:
    """The page_id in a record identifier; null where there is none."""
    return F.regexp_extract(name, r"urn:x-page:(-?[0-9]+)", 1).try_cast("long")
