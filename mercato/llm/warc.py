"""WARC archives: a writer, and a reader that salvages damaged files.

The reader checks every record: version line, headers, length, the blank lines
behind it, and its digest; of a compressed file, every gzip member too. After
a failed check it looks for the next version line or member that passes, goes
on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import stored
from mercato.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = re.compile(rb"WARC/\d\.\d+\r?\n")
# A place where a record or a gzip member may begin; a cut one need not end with its line.
START = re.compile(rb"WARC/\d\.\d+\r?\n|\x1f\x8b\x08")
GZIP = b"\x1f\x8b\x08"
# Size of a file on average, and at most (but for a single larger record).
FILE_BYTES, MOST_BYTES = 16 << 20, 256 << 20
# Payloads from this size on are stored once; equal ones become revisit records.
REVISIT_BYTES = 1000
PAGE, REFERS_PAGE = "WARC-Page-ID", "WARC-Refers-To-Page-ID"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing

def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page.cast("string"), F.lit("")), F.lit("|"), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line; nothing when the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_warc(
    pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2026-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES,
) -> str:
    """One response or revisit record per row, in files of about ``file_bytes``; returns ``path``.

    Of rows with equal payloads of at least ``revisit_bytes``, the one with the
    largest page is the response (all with it, if the page is repeated), the
    others revisit it. NULL html is an empty payload. The files are uncompressed
    WARC 1.1 text, so Spark's own writer puts them where the cluster stores
    things. Records are written where their rows are read, without a shuffle.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page).alias("page"), F.col(url).alias("url"), payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(
        F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # One row per repeated payload.
    rows = rows.join(stored(groups, "payloads"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    rows = rows.select("*", block.alias("block"), again.alias("again"), record_id(F.col("page"), F.col("digest")).alias("rid"))
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    text = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", kind), header("WARC-Record-ID", F.col("rid")), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:unknown"))),
        header(PAGE, F.col("page")),
        header("WARC-Refers-To", F.when(F.col("again"), record_id(F.col("first"), F.col("digest")))),
        header(REFERS_PAGE, F.when(F.col("again"), F.col("first"))), header("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("block", "UTF-8")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"), F.col("block"), F.lit("\r\n"))
    sizes = pages.agg(F.avg(F.octet_length(payload) + 1000).alias("mean"), F.max(F.octet_length(payload) + 1000).alias("most")).first()
    records = max(1, int(min(file_bytes / (sizes["mean"] or 1), MOST_BYTES / (sizes["most"] or 1))))
    # The line separator is the second of the two line ends behind a record.
    rows.select(text.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records).text(path)
    return path


# ---------------------------------------------------------------- reading

class Bad(Exception):
    """A check failed. ``resume`` is where the next record should begin, if the framing still says so."""

    def __init__(self, reason: str, resume: int | None = None):
        super().__init__(reason)
        self.reason, self.resume = reason, resume


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    end: int


def digest_ok(named: str, data: bytes) -> bool:
    """Whether a labelled digest, in hex or base32, is that of ``data``; unknown algorithms pass."""
    name, _, value = named.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(name, data)
    if value.lower() == found.hexdigest():
        return True
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)) == found.digest()
    except ValueError:
        return False


def plain_digest(named: str | None) -> str | None:
    """The bare lower-case hex form of a labelled digest."""
    value = (named or "").strip().partition(":")[2]
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() or None
    except ValueError:
        return None


def parse_record(data: bytes, at: int) -> Record:
    """The record at ``at``, or ``Bad``."""
    version = VERSION.match(data, at)
    if not version:
        raise Bad("no version line")
    blank = re.compile(rb"\r?\n\r?\n").search(data, version.end() - 1)
    if not blank:
        raise Bad("headers without end")
    headers: dict[str, str] = {}
    last = None
    for raw in re.split(rb"\r?\n", data[version.end() : blank.start()]):
        line = raw.decode("utf-8", "replace")
        if line[:1] in " \t" and last:
            headers[last] += " " + line.strip(" \t\r")
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Bad("malformed header")
        last = name.strip().lower()
        if last in headers and last != "warc-concurrent-to":
            # Two headers that ran into each other.
            raise Bad("repeated header")
        headers[last] = value.strip(" \t\r")
    if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys():
        raise Bad("missing header")
    if not re.fullmatch(r"\d{1,18}", headers["content-length"]):
        raise Bad("malformed length")
    start, end = blank.end(), blank.end() + int(headers["content-length"])
    if end > len(data):
        raise Bad("shorter than its length")
    tail = re.compile(rb"\r?\n\r?\n").match(data, end)
    if not tail:
        raise Bad("no blank lines behind the record")
    block = data[start:end]
    if "warc-block-digest" in headers and not digest_ok(headers["warc-block-digest"], block):
        follows = tail.end() == len(data) or START.match(data, tail.end())
        raise Bad("block digest", tail.end() if follows else None)
    return Record(headers, block, tail.end())


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its check sum is verified."""
    stream, out, place = zlib.decompressobj(31), [], at
    try:
        while not stream.eof:
            if place >= len(data):
                raise Bad("member without end")
            out.append(stream.decompress(data[place : place + 65536]))
            place += 65536
    except zlib.error as problem:
        raise Bad("damaged member") from problem
    return b"".join(out), min(place, len(data)) - len(stream.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, Record | None, str | None]]:
    """``(kind, start, end, record, reason)`` of all records and gaps; offsets are those of the file.

    Records inside a member have the member's offsets. A gap inside an intact
    member is reported with the member's offsets, too.
    """
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                content, end = inflate(data, at)
                found = [(kind, at, end, record, why) for kind, _, _, record, why in salvage(content)]
                if gap is not None and not any(kind == "record" for kind, *_ in found):
                    raise Bad("member without records")
            else:
                record = parse_record(data, at)
                end = record.end
                found = [("record", at, end, record, None)]
        except Bad as problem:
            if gap is None:
                gap, reason = at, problem.reason
            following = START.search(data, at + 1)
            at = problem.resume or (following.start() if following else len(data))
            continue
        if gap is not None:
            yield "gap", gap, at, None, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, len(data), None, reason


def http_payload(record: Record) -> tuple[bytes, int | None]:
    """The body behind the HTTP headers, and the length that these state."""
    head, _, body = record.block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return body, int(stated[1]) if stated else None


RECORD_TYPE = (
    "path string, kind string, start long, length long, reason string, record_type string, record_id string, target_uri string, "
    "refers_to_id string, page string, refers_to_page string, payload_digest string, payload_bytes long, payload binary"
)
NAMES = [c.split()[0] for c in RECORD_TYPE.split(", ")]


def describe(path: str, item: tuple, with_payload: bool) -> dict:
    kind, start, end, record, reason = item
    row = {"path": path, "kind": kind, "start": start, "length": end - start, "reason": reason}
    if record is None:
        return row
    h = record.headers
    row |= {
        "record_type": h["warc-type"].lower(), "record_id": h["warc-record-id"], "target_uri": h.get("warc-target-uri"),
        "refers_to_id": h.get("warc-refers-to"), "page": h.get(PAGE.lower()), "refers_to_page": h.get(REFERS_PAGE.lower())}
    if "http" in h.get("content-type", "") and "msgtype=request" not in h.get("content-type", ""):
        body, stated = http_payload(record)
    else:
        body, stated = record.block, None
    if row["record_type"] == "revisit":
        return row | {"payload_digest": plain_digest(h.get("warc-payload-digest")), "payload_bytes": stated}
    return row | {
        "payload_digest": hashlib.sha1(body).hexdigest(), "payload_bytes": len(body), "payload": body if with_payload else None}


def reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]

        def send(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, types)], NAMES)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for item in salvage(content.as_py()):
                    rows.append(describe(path.as_py(), item, with_payload))
                    held += 500 + len(rows[-1].get("payload") or b"")
                    if held > 1 << 20:
                        yield send(rows)
                        rows, held = [], 0
                if rows:
                    yield send(rows)

    return read


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, pattern: str = "*") -> DataFrame:
    """Every record and every gap of the files below ``path``, written once.

    Rows of kind ``record`` describe a record that passed all checks, rows of
    kind ``gap`` the bytes that were skipped and the first check that failed.
    Digest and size of a payload are computed, of a revisit record taken from
    its headers. Files are read whole, one at a time in a task, up to Spark's
    limit of 2 GB; the writer's are far smaller. An empty file has no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return stored(files.mapInArrow(reader(with_payload), RECORD_TYPE), "warc", rows=1)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as an archive and read back: one row per page, without its payload.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. NULL
    html is an empty payload and a NULL page stays NULL; repeated rows have a
    record each. Other columns are ignored, an empty table gives an empty table.
    A gap in the archive just written is an error.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    path = write_warc(pages, scratch_path(spark, "warc"))
    found = read_warc(spark, path, with_payload=False, pattern="part-*")
    gap = found.where("kind = 'gap'").select("path", "start", "reason").first()
    if gap is not None:
        raise ValueError(f"the archive cannot be read back: {gap['reason']} at {gap['start']} of {gap['path']}")
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_page").cast(kind).alias("refers_to"))
