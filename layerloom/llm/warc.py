"""WARC archives: a writer that marks repeated payloads, and a reader that salvages damaged files.

The writer makes one gzip member for each record and hands the members to Spark's text sink, whose committer makes the
files survive lost tasks on any file system. A gzip member ends with the high byte of its size, which is zero (an
empty member follows where it is not), so members are given without that byte and the sink's line separator is
``\\0``: the files are plain ``.warc.gz`` content, byte for byte.

The reader takes files of gzip members or of bare records. After a failed check (bad member, bad header, wrong
length, payload that does not fit its digest) it searches for the next offset at which a valid member or a version
line starts, goes on from there, and logs the bytes between as a quarantined gap.

Nulls, edges: a null payload is empty. A null id is written as an absent header and read as null. Of equal payloads
(at least ``min_revisit`` bytes) the smallest id is the response; rows that repeat an id with an equal payload are all
responses if it is the smallest. Empty tables give no records. An empty or wholly damaged file gives one gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm.common import scratch_path, small, stored

MIN_REVISIT = 100
RECORDS_PER_FILE = 4_000
VERSION = b"WARC/1.1\r\n"
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
_START = re.compile(rb"WARC/1\.[01]\r?\n")
READ_SCHEMA = (
    "path string, kind string, offset long, length long, reason string, record_type string, id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose last byte is zero (or a member and an empty one, for 16 MiB and more)."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def record(kind: str, rid: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit has the size and digest of the full payload in its header, and no block."""
    block = b"" if kind == "revisit" else payload
    head = [f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Identified-Payload-Length: {size}"]
    if rid is not None:
        head.append(f"WARC-Record-ID: <urn:page:{rid}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, payload: str, key: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with _payload, _size, _digest and _refers_to (null for responses).

    Only digests that occur twice or more are looked up, and payloads take part in no shuffle while those are few.
    """
    full = pages.withColumn("_payload", F.coalesce(F.col(payload), F.lit(""))).withColumn("_size", F.octet_length("_payload").cast("long")).withColumn("_digest", F.sha2("_payload", 256))
    firsts = full.where(F.col("_size") >= min_revisit).groupBy("_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = full.join(small(stored(firsts, "warc-digests")), "_digest", "left")
    refers = F.when(F.col("_first").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("_first"))), F.col("_first"))
    return found.withColumn("_refers_to", refers).drop("_first")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row of pages to gzipped WARC files below path."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, u, body, size, digest, ref in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                kind = "response" if ref is None else "revisit"
                out.append(member(record(kind, rid, u, body.encode(), size, digest, ref))[:-1])
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    rows = with_revisits(pages, payload, key).select(F.col(key).cast("long").alias("id"), F.col(url).alias("u"), F.when(F.col("_refers_to").isNull(), F.col("_payload")).otherwise("").alias("p"), "_size", "_digest", "_refers_to")
    made = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        name, sep, value = line.rstrip("\r").partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse_record(data: bytes, at: int = 0) -> tuple[dict | None, int, str]:
    """The record that starts at data[at:], where it ends, and what is wrong with it if it is None."""
    if not (m := _START.match(data, at)):
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", m.end())
    if end < 0:
        return None, at, "header does not end"
    h = _headers(data[at:end])
    if not h.get("content-length", "").isdigit():
        return None, at, "no length"
    start, stop = end + 4, end + 4 + int(h["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    kind, block = h.get("warc-type", ""), data[start:stop]
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit" and digest and hashlib.sha256(block).hexdigest() != digest:
        return None, at, "wrong digest"
    size = int(h["warc-identified-payload-length"]) if kind == "revisit" and h.get("warc-identified-payload-length", "").isdigit() else len(block)
    out = {"record_type": kind, "id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or hashlib.sha256(block).hexdigest(), "refers_to": _page(h.get("warc-refers-to")), "payload": None if kind == "revisit" else block}
    return out, stop + 4, ""




def salvage(data: bytes) -> Iterator[dict]:
    """Records (kind record) and quarantined byte gaps (kind gap) of one file, in file order."""
    at, bad, why = 0, None, ""
    while at < len(data):
        found, end, reason, lost = [], at, "no member or version line", ""
        if data[at : at + 3] == b"\x1f\x8b\x08":
            body, stop = _unzip_from(data, at)
            reason = "bad member"
            if body is not None:
                inner, end, reason, lost = 0, stop, "", ""
                while 0 <= inner < len(body):
                    rec, nxt, problem = parse_record(body, inner)
                    if rec is None:  # later records of the member may be whole
                        lost, nxt = lost or problem, body.find(b"WARC/1.", inner + 1)
                    else:
                        found.append(rec)
                    inner = nxt
                if lost and not found:
                    end, reason = at, lost
        elif data[at : at + 5] == b"WARC/":
            rec, end, reason = parse_record(data, at)
            found = [rec] if rec else []
        if reason:
            bad, why = (at, reason) if bad is None else (bad, why)
            nxt = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(nxt, default=len(data))
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        for rec in found:
            yield rec | {"kind": "record", "offset": at, "length": end - at}
        if lost:
            yield {"kind": "gap", "offset": at, "length": end - at, "reason": f"part of a member: {lost}"}
        at = end
    if bad is not None or not data:
        bad = bad or 0
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": why or "empty file"}


def _unzip_from(data: bytes, at: int, first: int = 1 << 16) -> tuple[bytes | None, int]:
    """Unzip one member, handing zlib growing slices so that a member costs its own length, not the file's."""
    z, pos, out, step = zlib.decompressobj(31), at, [], first
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error:
        return None, at
    return (b"".join(out), min(pos, len(data)) - len(z.unused_data)) if z.eof else (None, at)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA: records and gaps of every file below path. A file is read by one task."""
    fields = [f.strip().split()[0] for f in READ_SCHEMA.split(",")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for r in salvage(data):
                    r["path"] = name
                    if not payloads:
                        r["payload"] = None
                    held += len(r.get("payload") or b"") + 200
                    rows.append(r)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields} for x in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields} for x in rows], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, READ_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, payload)
    return read_archives(spark, path, payloads=False).where("kind = 'record'")
