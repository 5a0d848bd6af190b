"""WARC archives as Spark tables of text: records are written in segments with chunked framing and put together again.

An archive file is a gzip member whose records Spark's text writer separates by the blank lines that end a record. The
reader cuts the files at lines that begin with a version, so a file is streamed and never held whole, and files of
several members or of older versions are read too. The separator must not repeat its own beginning: Hadoop's line reader
misses such a one where a buffer ends within it. The writer breaks a chunk inside any version that a payload holds, so
the cut is safe for its own archives; elsewhere a record that comes out shorter than its Content-Length, or whose headers are
malformed, is reported by ``complete``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, new_path, numbered, write_table

#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
RECORD_BEGIN = re.compile(rb"(?:WARC/1\.)?[0-9]+\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, BASE32_HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: each 5 bytes make 8 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def chunked(payload: bytes, chunk: int) -> bytes:
    """Chunked transfer framing, with a break inside every version line of the payload."""
    marker, out, at = VERSION[:5].encode(), [], 0
    while at < len(payload):
        end = min(at + chunk, len(payload))
        found = payload.find(marker, at, end + len(marker) - 1)
        if found >= 0:
            end = min(end, found + 2)
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        data = body[line + 2 : line + 2 + size]
        if len(data) < size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        out.append(data)
        at = line + 4 + size


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, v in fields}, body


def write_warc(
    records: DataFrame, path: str, *, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 13, content_type: str = "text/html"
) -> None:
    """Write (record_id, url, payload binary, digest, refers_to) as archives under ``path``.

    A row with ``refers_to`` becomes a revisit record without payload, any other a response record. A response block
    of more than ``segment_bytes`` goes on in continuation records. A null payload is empty, a null url is left out.
    """

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for record in (r for row in batch.to_pylist() for r in each(row)):
                held.append(record)
                size += len(record)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    def each(row: dict) -> Iterator[bytes]:
        payload = row["payload"] or b""
        base = [f"WARC-Record-ID: {row['record_id']}"]
        if row["url"] is not None:
            base.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
        digest = f"WARC-Payload-Digest: sha1:{row['digest']}"
        if row["refers_to"] is not None:
            block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
            yield one(["WARC-Type: revisit", *base, digest, f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {row['refers_to']}"], block)
            return
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nTransfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
        n = max(1, -(-len(block) // segment_bytes))
        if n == 1:
            yield one(["WARC-Type: response", *base, digest], block)
            return
        yield one(["WARC-Type: response", *base, digest, "WARC-Segment-Number: 1"], block[:segment_bytes])
        for k in range(2, n + 1):
            head = ["WARC-Type: continuation", f"WARC-Record-ID: {row['record_id'][:-1]}:segment:{k}>"]
            head += [f"WARC-Segment-Origin-ID: {row['record_id']}", f"WARC-Segment-Number: {k}"]
            head += [f"WARC-Segment-Total-Length: {len(block)}"] * (k == n)
            yield one(head, block[(k - 1) * segment_bytes : k * segment_bytes])

    def one(head: list[str], block: bytes) -> bytes:
        text = VERSION + "\r\n".join([*head, "WARC-Date: 1970-01-01T00:00:00Z", f"Content-Length: {len(block)}"]) + "\r\n\r\n"
        return text.encode() + block

    rows = records.select("record_id", "url", "payload", "digest", "refers_to").mapInArrow(records_of, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def number(text: str | None) -> int | None:
    """A header's number; None where it is missing or malformed."""
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, type, url, digest, refers_to, origin_id, segment, total, block, complete.

    A record without a well-formed length, or with a malformed segment number or total, has ``complete`` false and what
    its other headers say. What stands before the first version line of a file is no record.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch["value"].to_pylist():
                begin = RECORD_BEGIN.match(raw or b"")
                if not begin:
                    continue
                head, _, rest = raw[begin.end() :].partition(b"\r\n\r\n")
                h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ":" in x)}
                length, segment, total = (number(h.get(c)) for c in ("content-length", "warc-segment-number", "warc-segment-total-length"))
                good = (segment is not None or "warc-segment-number" not in h) and (total is not None or "warc-segment-total-length" not in h)
                rows.append(
                    {
                        "record_id": h.get("warc-record-id"),
                        "type": h.get("warc-type"),
                        "url": h.get("warc-target-uri"),
                        "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        "refers_to": h.get("warc-refers-to"),
                        "origin_id": h.get("warc-segment-origin-id"),
                        "segment": segment,
                        "total": total,
                        "block": rest[:length],
                        "complete": good and length is not None and len(rest) >= length,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema(
        [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string())]
        + [("origin_id", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("complete", pa.bool_())]
    )
    schema = "record_id string, type string, url string, digest string, refers_to string, origin_id string, segment long, total long, block binary, complete boolean"
    raw = spark.read.option("lineSep", "\n" + VERSION[:7]).text(path)
    return raw.select(F.col("value").cast("binary")).mapInArrow(parse, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """Join segments, verify and decode.

    Records without a segment number pass straight through. Segments are grouped by origin, ordered by number, and must
    run from 1 without a gap to the record with the total length, which must fit. Of segments with one number the first
    in byte order counts. Returns record_id, type, url, digest, refers_to, payload, payload_bytes, segments and valid;
    a record that fails keeps its row, with a null payload. A revisit has no payload; payload_bytes is then the length
    that its HTTP header states. A payload is one row's value, so it is bounded by what a row can hold (2 GB).
    """
    whole = records.where("segment is null").select(
        "record_id", "type", "url", "digest", "refers_to", "block", F.lit(1).cast("long").alias("segments"), "complete"
    )
    parts = records.where("segment is not null").withColumn("id", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    joined = (
        parts.groupBy("id")
        .agg(
            *(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "url", "digest", "refers_to")),
            F.array_sort(F.collect_set(F.struct("segment", "block", "complete"))).alias("all"),
            F.max("total").alias("total"),
        )
        .withColumn("parts", F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["segment"] != x["segment"])))
        .withColumn("segments", F.size("parts").cast("long"))
        .withColumn("block", F.expr("aggregate(parts, cast('' as binary), (acc, x) -> concat(acc, x.block))"))
        .withColumn(
            "complete",
            F.forall("parts", lambda x: x["complete"])
            & (F.col("segments") == F.element_at("parts", -1)["segment"])
            & (F.col("parts")[0]["segment"] == 1)
            & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False)),
        )
        .select(F.col("id").alias("record_id"), "type", "url", "digest", "refers_to", "block", "segments", "complete")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes, valid = [], [], []
            for kind, digest, block, complete in zip(*(batch[c].to_pylist() for c in ("type", "digest", "block", "complete")), strict=True):
                header, body = http_parts(block or b"")
                if kind == "revisit":
                    payloads.append(None)
                    sizes.append(number(header.get("content-length")) or 0)
                    valid.append(bool(complete))
                    continue
                payload = dechunked(body) if header.get("transfer-encoding", "").lower() == "chunked" else body
                good = bool(complete) and payload is not None
                good = good and digest in (None, base64.b32encode(hashlib.sha1(payload).digest()).decode())
                payloads.append(payload if good else None)
                sizes.append(len(payload) if good else None)
                valid.append(good)
            keep = ["record_id", "type", "url", "digest", "refers_to", "segments"]
            arrays = [batch[c] for c in keep] + [pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(valid, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "payload", "payload_bytes", "valid"])

    schema = "record_id string, type string, url string, digest string, refers_to string, segments long, payload binary, payload_bytes long, valid boolean"
    return whole.unionByName(joined).mapInArrow(decode, schema)


def archive_pages(pages: DataFrame, *, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 13, min_revisit_bytes: int = 0) -> str:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder; returns their path.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, the one with the smallest page_id (a null one last,
    then the first in the table) is a response and the others revisit it. A null html is empty. Other columns are not read.
    """
    held = numbered(pages.select("page_id", "url", "html"), "warc-pages")
    rows = held.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"), F.col("__rid").alias("rid"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("record_id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.hex("rid"), F.lit(">")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")
    ids = write_table(rows.select("rid", "page_id", "record_id", "digest", F.octet_length("payload").alias("size")), "warc-ids")
    firsts = write_table(
        ids.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min_by("record_id", order).alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "warc-firsts",
    )
    refers = (
        ids.join(firsts, "digest")
        .where(F.col("record_id") != F.col("first_id"))
        .select(F.col("rid").alias("__rid"), F.col("first_id").alias("refers_to"))
    )
    path, refers = new_path(pages.sparkSession, "warc"), write_table(refers, "warc-refers")
    write_warc(rows.join(bounded(refers), rows["rid"] == refers["__rid"], "left"), path, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
    return path
