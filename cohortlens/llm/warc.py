"""WARC archives of pages: writing, segment reassembly, chunked framing.

``write_archives`` gives each page an HTTP response in chunked transfer coding inside a WARC record.  A
message over ``segment`` bytes is cut: the first part is the response record, segment 1, and each further part a
``continuation`` record that names the first one's id, its own number and, in the last, the
total length.  Of pages with equal payloads of at least ``REVISIT_BYTES`` that with the smallest id is a response and the
others are ``revisit`` records without a payload.  Spark writes the files, so any file system that it can write will do.

``read_archives`` reads whole files (``archive_bytes`` each at most, but for one record that is longer) and cuts
records by their Content-Length.  Whole messages are decoded where they are read; only segments are
shuffled: grouped by origin, ordered by number, checked against the total length, joined and
decoded.  Segments may lie in any archives.  A revisit takes its length from the record that it names, by its id
and digest.

Defined results: a null payload is an empty one; rows without an id are responses (no record
can name them); every row of the smallest id of a payload is a response.  Identical repeats of a segment
count once.  A record that can't be put together has a null payload and says why in ``fault``.
Only the id, url and payload columns are read, so extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .shared import written

REVISIT_BYTES = 100
SEGMENT_BYTES = 16 << 10  # of an HTTP message in one record
CHUNK_BYTES = 4 << 10  # of a payload in one transfer chunk
ARCHIVE_BYTES = 16 << 20
SALTS = 16
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
_HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_NAME = re.compile(r"urn:x-page:(-?\d*)(?:#(\d+))?")


class Fault(ValueError):
    """A record or message that doesn't keep to the format."""


# -- framing -----------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer coding."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding: chunk extensions and trailer fields are skipped."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise Fault("chunk without a size line")
        digits = body[at:end].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise Fault("chunk size is not a number")
        n, at = int(digits, 16), end + 2
        if not n:
            break
        if body[at + n:at + n + 2] != CRLF:
            raise Fault("chunk is cut short")
        out.append(body[at:at + n])
        at += n + 2
    while True:  # trailer fields up to an empty line
        end = body.find(CRLF, at)
        if end < 0:
            raise Fault("body does not end")
        if end == at:
            break
        at = end + 2
    if end + 2 != len(body):
        raise Fault("bytes after the body")
    return b"".join(out)


def fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.split(CRLF):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if colon:
            name = key.strip().lower().decode("utf-8", "replace")
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise Fault("message without an end of its header")
    named = fields(head)
    if named.get("transfer-encoding", "").lower() == "chunked":
        return dechunked(body)
    if "content-length" in named and named["content-length"] != str(len(body)):
        raise Fault("message has another length than it says")
    return body


def record(kind: str, head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in head), b"Content-Length: %d" % len(block)]
    return CRLF.join([*lines, b"", block, b"", b""])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise Fault(f"no record at byte {at}")
        named = fields(data[at:end])
        n = named.get("content-length", "")
        if not n.isdigit():
            raise Fault(f"record without a length at byte {at}")
        block = data[end + 4:end + 4 + int(n)]
        at = end + 4 + int(n)
        if len(block) < int(n) or data[at:at + 4] != b"\r\n\r\n":
            raise Fault(f"record is cut short before byte {at}")
        at += 4
        yield named, block


# -- writing -------------------------------------------------------------------

def _page_records(page: int | None, serial: int, url: str | None, payload: bytes, digest: str, refers: int | None, segment: int) -> Iterator[bytes]:
    name = f"urn:x-page:{'' if page is None else page}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Record-ID", f"<{name}#{serial}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers}>")]
        yield record("revisit", head, _HEADER + CRLF)
        return
    message = _HEADER + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(message) <= segment:
        yield record("response", head, message)
        return
    yield record("response", [*head, ("WARC-Segment-Number", "1")], message[:segment])
    for k, i in enumerate(range(segment, len(message), segment), 2):
        more = [("WARC-Segment-Total-Length", str(len(message)))] if i + segment >= len(message) else []
        yield record("continuation", [("WARC-Record-ID", f"<{name}/{k}#{serial}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
                                      ("WARC-Segment-Origin-ID", f"<{name}#{serial}>"), ("WARC-Segment-Number", str(k)), *more], message[i:i + segment])


def _salted(df: DataFrame) -> DataFrame:
    """Rows dealt by their serial number, so that equal rows are dealt as well."""
    return df.withColumn("_salt", F.pmod("serial", F.lit(SALTS)).cast("int"))


def _each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_refers(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``digest`` and ``refers``: the smallest id of an equal payload of at least ``least`` bytes, null where
    that is the row's own.  One payload may hold any share of the rows: its smallest id is a partial
    aggregate, and it goes back to the rows by digest and salt."""
    rows = rows.withColumn("digest", F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256))
    shared = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
              .agg(F.min("page").alias("_least"), F.count("page").alias("_n")).where("_n > 1").drop("_n"))
    rows = _salted(rows.withColumn("serial", F.monotonically_increasing_id())).join(_each_salt(shared), ["digest", "_salt"], "left")
    return rows.select("page", "serial", "url", "payload", "digest", F.when(F.col("page") != F.col("_least"), F.col("_least")).alias("refers"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   segment: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, least: int = REVISIT_BYTES) -> None:
    """Write the pages as compressed WARC files into the new folder ``path``.

    A task numbers its files, each of at most ``archive_bytes`` before compression, and the write partitions by that number; a page's
    continuation records may come to lie in the next file.  A null url is written as an empty one; its
    control characters and spaces are percent-encoded."""
    rows = _with_refers(pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload")), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = held = 0
        out: list[bytes] = []
        files: list[int] = []

        def full():
            return pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], names=["file", "value"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page", "serial", "url", "payload", "digest", "refers")]
            for i in range(len(batch)):
                page, serial, link, text, digest, refers = (c[i].as_py() for c in columns)
                for r in _page_records(page, serial, link, (text or "").encode(), digest, refers, segment):
                    if size and size + len(r) > archive_bytes:
                        file, size = file + 1, 0
                    size, held = size + len(r), held + len(r)
                    out.append(r[:-1])  # the writer ends each value with the last line feed
                    files.append(file)
                if held > 4 << 20:
                    yield full()
                    out, files, held = [], [], 0
        if out:
            yield full()

    lines = rows.mapInArrow(run, "file int, value binary").select("file", F.col("value").cast("string"))
    lines.write.partitionBy("file").text(path, compression="gzip", lineSep="\n")


# -- reading -------------------------------------------------------------------

_PARSED = ("kind string, page long, serial long, url string, refers long, said string, segment int, total long, "
           "payload binary, payload_bytes long, digest string, fault string")
_NAMES = [f.split()[0] for f in _PARSED.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]


def _named(text: str) -> tuple[int | None, int | None]:
    m = _NAME.search(text)
    if not m:
        return None, None
    return (int(m[1]) if m[1] not in ("", "-") else None), (int(m[2]) if m[2] else None)


def _decoded(message: bytes, said: str | None, keep: bool) -> tuple:
    """(payload, bytes, digest, fault) of a whole message."""
    try:
        payload = payload_of(message)
    except Fault as e:
        return None, None, None, str(e)
    digest = hashlib.sha256(payload).hexdigest()
    if said and said != digest:
        return None, None, None, "payload has another digest than its record says"
    return (payload if keep else None), len(payload), digest, None


def _row(named: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind = named.get("warc-type", "")
    said = named.get("warc-payload-digest", "").removeprefix("sha256:") or None
    segment = int(named["warc-segment-number"]) if named.get("warc-segment-number", "").isdigit() else None
    total = int(named["warc-segment-total-length"]) if named.get("warc-segment-total-length", "").isdigit() else None
    page, serial = _named(named.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id", ""))
    refers = _named(named["warc-refers-to"])[0] if kind == "revisit" and "warc-refers-to" in named else None
    rest = (None, None, None, None)
    if kind == "response":
        rest = _decoded(block, said, keep) if segment is None else (block, None, None, None)
    elif kind == "continuation":
        rest = (block, None, None, None)
    return (kind, page, serial, named.get("warc-target-uri"), refers, said, segment, total, *rest)


def parsed(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``.  Whole messages are decoded (payloads only with ``keep``); of
    segments the block is in ``payload``.  What follows a broken record in its file is one row of kind ``broken``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                try:
                    data = content.as_buffer().to_pybytes()
                    for named, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                        rows.append(_row(named, block, keep))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                except Fault as e:
                    rows.append(("broken", *(None,) * 10, str(e)))
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, _PARSED)


def reassembled(parts: DataFrame, keep: bool = False) -> DataFrame:
    """Messages put together from segments: grouped by origin, ordered by number, verified, decoded.

    A group holds one message, whatever the corpus.  Missing numbers, two different blocks of one number
    and a length other than the stated one are faults."""
    first = F.col("kind") == "response"
    grouped = parts.groupBy("page", "serial").agg(
        F.array_sort(F.collect_set(F.struct("segment", F.col("payload").alias("block")))).alias("blocks"), F.max(F.when(first, F.col("url"))).alias("url"),
        F.max(F.when(first, F.col("said"))).alias("said"), F.max("total").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                page, serial, blocks, url, said, total = (batch.column(c)[i].as_py() for c in ("page", "serial", "blocks", "url", "said", "total"))
                numbers = [b["segment"] for b in blocks]
                message = b"".join(b["block"] or b"" for b in blocks)
                if numbers != list(range(1, len(numbers) + 1)):
                    rest = (None, None, None, f"segments {numbers}")
                elif total != len(message):
                    rest = (None, None, None, f"{len(message)} bytes of {total}")
                else:
                    rest = _decoded(message, said, keep)
                row = ("response", page, serial, url, None, said, None, total, *rest)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

    return grouped.mapInArrow(run, _PARSED)


def read_archives(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, fault`` and, with ``keep``, ``payload`` (binary; of a
    revisit null) of every page in the archives under ``path``."""
    rows = written(parsed(spark, path, keep), "warc-records")
    cut = F.col("segment").isNotNull()
    responses = rows.where((F.col("kind") == "response") & ~cut).unionByName(reassembled(rows.where(cut), keep))
    revisits = rows.where("kind = 'revisit'")
    wanted = revisits.select(F.col("refers").alias("page"), F.col("said").alias("digest")).distinct()
    known = responses.where("fault IS NULL").select("page", "digest", "payload_bytes").join(wanted, ["page", "digest"]).distinct()
    known = _each_salt(known.select(F.col("page").alias("refers"), F.col("digest").alias("said"), F.col("payload_bytes").alias("_bytes")))
    revisits = (_salted(revisits).join(known, ["refers", "said", "_salt"], "left")
                .withColumn("payload_bytes", F.col("_bytes")).withColumn("digest", F.when(F.col("_bytes").isNotNull(), F.col("said")))
                .withColumn("fault", F.when(F.col("_bytes").isNull(), F.lit("no response with this id and digest"))).select(*_NAMES))
    out = responses.unionByName(revisits).unionByName(rows.where("kind = 'broken'"))
    columns = [F.col("page").alias("page_id"), "url", F.col("kind").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"),
               F.col("refers").alias("refers_to"), "fault"]
    return out.select(*columns, *(["payload"] if keep else []))


def round_trip_sql() -> str:
    """DuckDB SQL for the rows of ``round_trip`` over the table ``pages`` (without ``fault``, which is null)."""
    return (
        "WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), "
        f"f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest) "
        "SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.least < p.page_id THEN 'revisit' ELSE 'response' END AS record_type, "
        "CASE WHEN f.least < p.page_id THEN f.least END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder and read them back: one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, f"warc-archives-{uuid.uuid4().hex}")
    write_archives(pages, path)
    return read_archives(spark, path, keep=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")
