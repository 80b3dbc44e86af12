"""WARC archives: written with revisits and segmented records, read back with segment reassembly.

Writing: a page's record is an HTTP response whose body is the payload in chunked transfer framing.  Pages with equal
payloads become revisits of the one with the smallest id.  A block longer than ``segment_bytes`` is cut into a first
record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, WARC-Segment-Total-Length).

Reading: records are parsed from archive bytes and finished in their tasks.  Segments meet by the id of their origin,
beside the finished records, in one shuffle; there they are put in order, checked against the total length, and their chunked framing is decoded.

Payloads without an equal are written where they are read.  Of equal ones only a digest travels: minima are
pre-aggregated by digest, and a payload that a third of the pages share is met by a broadcast of the few like it.  Nulls: a null payload is empty, a null url is written as ``-``; null ids sort
last, are written empty and come back null.  Rows with the smallest id of their payload are all responses, repeated
rows too; record ids hold a number of the row's own, so the segments of rows that share an id, or have none, stay apart.  Damaged input: a record cut short, missing or repeated segments, a wrong total or broken framing give
``complete`` false and whatever bytes there are; repeated equal segments count once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for, join_skewed, perhaps_among, staged

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 4 << 20
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_SPACE = uuid.UUID("9b2c6a4e-7d0f-5c1a-8e53-1f6d2b7a9c04")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(body), size) if (p := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> tuple[bytes, bool]:
    """Body of a chunked message, and whether its framing is whole.  Extensions of chunks and trailers are passed over."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        try:
            size = int(data[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out), False
        if size == 0:
            return b"".join(out), data.endswith(b"\r\n\r\n") or data[line:] == b"\r\n"
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if data[at - 2 : at] != b"\r\n":
            return b"".join(out), False


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + END


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def page_records(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, row: str | None = None, refers_row: str | None = None, sha1: str | None = None) -> Iterator[bytes]:
    """Records of one page; ``row`` tells rows apart that share an id, ``refers_row`` is that of the page referred to.

    A revisit needs no payload if ``sha1``, the payload's digest in hex, is given.
    """

    def named(page: int | None, at: str | None, i: int) -> str:
        return record_id("page", "" if page is None else page, i, *([] if at is None else [at]))

    own = named(page_id, row, 0)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", (url or "-").replace("\r", "%0D").replace("\n", "%0A")), ("X-Page-Id", "" if page_id is None else str(page_id))]
    digest = ("WARC-Payload-Digest", "sha1:" + (base64.b32encode(bytes.fromhex(sha1)).decode() if sha1 else base32_sha1(payload)))
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, profile, ("WARC-Refers-To", named(refers_to, refers_row, 0)), ("X-Refers-To-Page", str(refers_to)), kind], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, kind], block)
        return
    last = -(-len(block) // segment_bytes)
    for i in range(last):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        segment = ("WARC-Segment-Number", str(i + 1))
        if i == 0:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, segment, kind], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] * (i == last - 1)
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", named(page_id, row, i)), *common, ("WARC-Segment-Origin-ID", own), segment, *total], part)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers in lower case, block, whole) of each record; bytes between records are passed over."""
    at = 0
    while (at := archive.find(b"WARC/1.", at)) >= 0:
        head = archive.find(END, at)
        if head < 0:
            return
        lines = archive[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not size.isdecimal():
            at = head
            continue
        block = archive[head + 4 : head + 4 + int(size)]
        yield headers, block, len(block) == int(size)
        at = head + 4 + len(block)


def with_originals(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, row, refers_row, sha1): the page that each later page with an equal payload of
    ``least_bytes`` repeats.

    row tells rows with equal payloads apart, refers_row is that of one row of the page referred to.  The payload of a
    page that repeats another is null.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    equal = staged(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = equal.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = perhaps_among(rows, equal, "sha1", "equal")
    later = F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()) & (F.octet_length("payload") >= least_bytes)
    twins = join_skewed(rows.where("equal"), equal, "sha1", "n", total, "left")
    twins = twins.select("page_id", "url", F.when(~later, F.col("payload")).alias("payload"), F.when(later, F.col("first")).alias("refers_to"), F.monotonically_increasing_id().cast("string").alias("row"), "sha1")
    # staged, as the number must be the same wherever a row is read again
    twins = staged(twins)
    ends = twins.where("refers_to IS NULL").groupBy("sha1", "page_id").agg(F.min("row").alias("refers_row"))
    ends = equal.join(ends, F.expr("first = page_id") & (equal.sha1 == ends.sha1)).select(equal.sha1, "refers_row", "n")
    again = join_skewed(twins.where("refers_to IS NOT NULL"), ends, "sha1", "n", total)
    columns = ["page_id", "url", "payload", "refers_to", "row", "refers_row", "sha1"]
    alone = rows.where("NOT equal").withColumns({"refers_to": F.lit(None).cast("long"), "row": F.col("sha1"), "refers_row": F.lit(None).cast("string")})
    return alone.select(*columns).union(twins.where("refers_to IS NULL").withColumn("refers_row", F.lit(None).cast("string")).select(*columns)).union(again.select(*columns))


def write(pages: DataFrame, *, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive) of about ``archive_bytes`` each from (page_id, url, payload, refers_to, row, refers_row, sha1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    for r in page_records(*row[:4], segment_bytes, *row[4:]):
                        held.append(r)
                        size += len(r)
                    if size >= archive_bytes:
                        yield pa.record_batch([pa.array([b"".join(held)])], names=["archive"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)])], names=["archive"])

    return pages.select("page_id", "url", "payload", "refers_to", "row", "refers_row", "sha1").mapInArrow(run, "archive binary")


_PART = "origin string, number int, total long, page_id long, url string, type string, refers_to long, digest string, whole boolean, block binary"
_READ = "page_id long, url string, record_type string, refers_to long, digest string, payload binary, payload_bytes long, payload_digest string, complete boolean"


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdecimal() else None


def read(archives: DataFrame, *, n: int | None = None, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of (archive) rows, reassembled.

    (page_id, url, record_type, refers_to, digest as written, payload, payload_bytes, payload_digest as read, complete);
    a revisit has no payload of its own.
    """
    parts, out = _schema(_PART), _schema(_READ)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block, whole in parse(archive or b""):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = _whole_number(h.get("warc-segment-number"))
                    origin = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
                    rows.append((origin, number, _whole_number(h.get("warc-segment-total-length")), _whole_number(h.get("x-page-id")), h.get("warc-target-uri"), kind, _whole_number(h.get("x-refers-to-page")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, whole, block))
                    held += len(block)
                    if held >= 1 << 20:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), parts.types, strict=True)], schema=parts)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), parts.types, strict=True)], schema=parts)

    def body(block: bytes) -> tuple[bytes, bool]:
        head, _, rest = block.partition(END)
        return dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else (rest, True)

    def finished(first: tuple, block: bytes, whole: bool) -> tuple:
        _, _, _, page, url, kind, refers, digest, *_ = first
        if kind == "revisit":
            return page, url, kind, refers, digest, None, None, None, whole
        payload, framed = body(block)
        own = base32_sha1(payload)
        return page, url, kind, None, digest, payload if with_payload else None, len(payload), own, whole and framed and own == (digest or own)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records are finished where they are parsed; segments go on as they are."""
        done = 0
        for batch in records(batches):
            ends, rows = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] is None and row[5] != "continuation":
                    ends.append((*finished(row, row[9], row[8]), str(done), *[None] * 9))
                    done += 1
                else:
                    rows.append((*[None] * 9, *row))
            both = pa.schema([*out, *(pa.field("p_" + f.name, f.type) for f in parts)])
            if ends or rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*ends, *rows, strict=True), both.types, strict=True)], schema=both)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, rows = None, []

        def whole() -> pa.RecordBatch:
            by = {}
            first = min(rows, key=lambda r: (r[1] is None, r[1] or 0, r[5] == "continuation"))
            good = True
            for r in rows:
                good &= r[8] and by.setdefault(r[1], r[9]) == r[9]
            block = b"".join(by[k] for k in sorted(by, key=lambda k: (k is None, k or 0)))
            total = [r[2] for r in rows if r[2] is not None]
            good = good and sorted(by, key=lambda k: k or 0) == list(range(1, len(by) + 1)) and set(total) == {len(block)} and first[5] != "continuation"
            row = finished((*first[:5], "response", *first[6:]), block, good)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, out.types, strict=True)], schema=out)

        for batch in batches:
            ends = batch.filter(pc.is_valid(batch.column("record_type")))
            if ends.num_rows:
                yield pa.record_batch(ends.columns[: len(out)], schema=out)
            segments = batch.filter(pc.is_null(batch.column("record_type")))
            for row in zip(*(c.to_pylist() for c in segments.columns[len(out) :]), strict=True):
                if row[0] != origin and rows:
                    yield whole()
                    rows = []
                origin = row[0]
                rows.append(row)
        if rows:
            yield whole()

    n = n or buckets_for(archives)
    both = ", ".join([_READ, *("p_" + x for x in _PART.split(", "))])
    rows = archives.select("archive").mapInArrow(single, both)
    # finished records are dealt out by number; they are a few values each where payloads aren't asked for
    rows = rows.repartition(n, "p_origin").sortWithinPartitions("p_origin", "p_number")
    return rows.mapInArrow(assemble, _READ)


def archived_pages(pages: DataFrame, *, least_bytes: int = 0, **options) -> DataFrame:
    """Pages written as records, the archives kept in the shared folder and read back, revisits resolved by the page
    they refer to: (page_id, payload_bytes, payload_digest, record_type, refers_to, complete)."""
    found = staged(read(staged(write(with_originals(pages, least_bytes=least_bytes, **options))), with_payload=False))
    ends = found.where("record_type = 'response'")
    again = found.where("record_type = 'revisit'").withColumn("of", F.concat_ws("/", F.col("refers_to").cast("string"), "digest"))
    counts = again.groupBy("of").agg(F.count("*").alias("n"))
    origin = ends.where("page_id IS NOT NULL").select(F.concat_ws("/", F.col("page_id").cast("string"), "payload_digest").alias("of"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).dropDuplicates(["of"]).join(counts, "of")
    again = join_skewed(again, staged(origin), "of", "n", again.count(), "left")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete").union(again.select("page_id", F.col("b"), F.col("d"), "record_type", "refers_to", F.col("complete") & F.col("d").isNotNull()))
