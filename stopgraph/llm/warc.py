"""WARC archives: a writer that dedups payloads by digest, and a splittable reader.

Each record is one gzip member.  The reader's tasks take byte ranges of a file: a task
looks for gzip magic in its range, accepts a candidate only if what it inflates to begins
with a WARC version line and headers that parse, and owns every record whose member *starts*
inside the range, reading past the range's end where the last one does.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_path, utf8

#: Fixed values of the format.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a split, and of one read.
SPLIT, BLOCK = 8 << 20, 1 << 20
#: Tasks of a read at most; each then takes several splits, one after the other.
MOST_TASKS = 20_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; a plain path is local to all, as a mounted share is."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None, length: int) -> bytes:
    """One record with its headers; a revisit has no body but keeps the payload's length."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", DATE)]
    if uri:
        head.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Payload-Length", str(length))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    return lines + payload + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in ``folder``; one row a file.

    Of pages with equal payloads of at least ``least`` bytes the smallest ``page_id`` is
    written as ``response`` and the others as ``revisit``; smaller ones are all responses.
    A null html is an empty payload, a null url gives no target, a null page_id is written
    with an empty id and is never the one that others refer to unless all ids are null;
    of rows with one page_id and equal payloads each is a response if the id is smallest.
    Extra columns are ignored.  Files have names of their own for each attempt, so only
    files in the returned manifest ``(file, bytes, records)`` count, and the manifest is
    written before anything is read: a lost or doubled task leaves files nobody reads.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # only payloads with copies need the join; most rows have a digest of their own
    many = first.where((F.col("copies") > 1) & (F.col("size") >= least)).select("sha", "size", "first")
    rows = rows.join(many, ["sha", "size"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, path, size, n = None, None, 0, 0
        for b in batches:
            page, url, first_id = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            data, off = utf8(b.column(2))
            for k in range(b.num_rows):
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(_open(path)[1], compression=None)
                body = data[off[k] : off[k + 1]].tobytes()
                again = first_id[k] is not None and first_id[k] != page[k]
                own = "" if page[k] is None else str(page[k])
                packed = member(record("revisit" if again else "response", own, url[k], b"" if again else body, digest(body), str(first_id[k]) if again else None, len(body)))
                out.write(packed)
                size, n = size + len(packed), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return rows.select("page_id", "url", "html", "first").mapInArrow(run, "file string, bytes long, records long")


def _members(source, length: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(start, inflated bytes) of the WARC members that start in [begin, end)."""
    window, base = b"", begin  # window holds the file from base on

    def fill(upto: int) -> None:
        nonlocal window, length
        while base + len(window) < min(upto, length):
            source.seek(base + len(window))
            got = source.read(max(BLOCK, upto - base - len(window)))
            if not got:  # shorter than the manifest says
                length = base + len(window)
                break
            window += got

    at = begin
    while at < end:
        fill(at + BLOCK)
        found = window.find(MAGIC, at - base)
        if found < 0:
            at = base + max(len(window) - 2, 0)
            if base + len(window) >= length:
                return
            window, base = window[at - base :], at
            continue
        at = base + found
        if at >= end:
            return
        unpack, head, pos = zlib.decompressobj(31), b"", at
        try:
            while b"\r\n\r\n" not in head and head.startswith(b"WARC/1."[: len(head)]) and not unpack.eof:
                fill(pos + 4096)
                piece = window[pos - base : pos - base + 4096]
                if not piece:
                    break
                head += unpack.decompress(piece)
                pos += len(piece)
            valid = sound(head)
        except zlib.error:
            valid = False
        if not valid:
            at += 1
            continue
        unpack, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                fill(pos + BLOCK)
                piece = window[pos - base : pos - base + BLOCK]
                if not piece:
                    break
                parts.append(unpack.decompress(piece))
                pos += len(piece)
        except zlib.error:
            at += 1
            continue
        if not unpack.eof:
            at += 1
            continue
        pos -= len(unpack.unused_data)
        yield at, b"".join(parts)
        window, base, at = window[pos - base :], pos, pos


def sound(raw: bytes) -> bool:
    """Whether ``raw`` begins with a whole header block of a record: version, fields, type, id and length."""
    head, end, _ = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or not version.startswith(b"WARC/1."):
        return False
    names = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or not name.isascii():
            return False
        names[name.strip().lower()] = value.strip()
    return names.get(b"content-length", b"").isdigit() and bool(names.get(b"warc-type")) and bool(names.get(b"warc-record-id"))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the body of Content-Length bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    return fields, rest[: int(fields.get("content-length", len(rest)))]


READ_SCHEMA = "file string, start long, warc_type string, record_id string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"


def read(spark: SparkSession, manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the files in ``manifest(file, bytes)``, whatever the split size.

    Splits are rows, dealt over the cluster; a task reads its ranges one after the other
    and holds one record at a time.  Bytes that look like a member but do not inflate to a
    WARC header are skipped; a cut last member is left out.  Digests in a response's row
    are computed from the payload read; a revisit's come from its headers.
    """
    parts = manifest.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("begin"))
    # a split a task, and no merging of tasks: their rows are small but their ranges are not
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    parts = parts.repartition(min(int(n), MOST_TASKS), "file", "begin")

    def run(batches):
        for b in batches:
            for file, length, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, path = _open(file)
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for start, raw in _members(source, length, begin, min(begin + split, length)):
                        head, body = parse(raw)
                        kind = head.get("warc-type", "")
                        own = kind != "revisit"
                        strip = lambda v: None if v is None else v.removeprefix("<urn:page:").removesuffix(">")
                        rows.append((file, start, kind, strip(head.get("warc-record-id")), head.get("warc-target-uri"), digest(body) if own else head.get("warc-payload-digest", "").removeprefix("sha1:"), len(body) if own else int(head.get("x-payload-length", 0)), strip(head.get("warc-refers-to")), body))
                        held += len(body)
                        if held >= BLOCK:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return parts.mapInArrow(run, READ_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "warc_type", "record_id", "target_uri", "payload_digest", "payload_length", "refers_to", "payload"])


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back and report each record."""
    folder = shared_path(spark, "warc")
    manifest = Scratch(spark).table(write(spark, pages, folder, least), "warc-files")
    return read(spark, manifest)
