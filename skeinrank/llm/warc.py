"""WARC archives: a writer with revisit records, and a salvage reader.

Writer: one gzip member for each record; equal payloads of a least size are written once, the others revisit it. Each
task writes its own archives into a shared folder, under names that hold the attempt, and reports them; only what
successful attempts report is read.

Salvage reader: checks each record's framing, lengths and digests. Where a check fails it searches for the next gzip
member or version line that leads to a valid record, goes on there, and reports the bytes between as a quarantined gap
with the reason. Archives are read window by window, so memory is bounded by the longest member, inflated; a length
that leads beyond the archive's end is not believed.

Cases: a null html is an empty payload, a null url an empty target; payloads of any length are written whole; rows with
a null page_id are archived, and come back with a null one; rows that repeat a page_id are records of their own (all
that have the largest page_id of a group are responses); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_dealt, materialize, shared_path

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
STEP = 1 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, target: str, block: bytes, extra: dict[str, str], date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, not compressed."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]", " ", target), **extra, "WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A page as a response, or as a revisit that has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = f"urn:page:{'' if page_id is None else page_id}"
    extra = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": _digest(payload)}
    if refers_to is None:
        return record("response", name, url, http + payload, extra)
    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record("revisit", name, url, http, extra)


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --------------------------------------------------------------------------- reading


class Invalid(Exception):
    """A check failed; the text says which."""


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Source:
    """Random access to an archive: read(offset, length) gives fewer bytes at its end only."""

    read: Callable[[int, int], bytes]
    size: int
    window: tuple[int, bytes] = field(default=(0, b""))

    def get(self, at: int, n: int) -> bytes:
        start, held = self.window
        if not (start <= at and at + n <= start + len(held)):
            start, held = self.window = (at, self.read(at, min(max(n, STEP), max(0, self.size - at))))
        return held[at - start : at - start + n]


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Invalid("version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Invalid("header line")
        out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit() or "warc-type" not in out:
        raise Invalid("missing header")
    return out


def _checked(headers: dict[str, str], block: bytes, tail: bytes) -> None:
    if len(block) != int(headers["content-length"]):
        raise Invalid("length")
    if tail != b"\r\n\r\n":
        raise Invalid("record end")
    if (digest := headers.get("warc-block-digest", "")).lower().startswith("sha1:") and digest[5:].upper() != _digest(block)[5:]:
        raise Invalid("block digest")


def _plain(get: Callable[[int, int], bytes], at: int, offset: int, end: int) -> Record:
    """The record whose version line is at `at`, in what goes up to `end`."""
    n = 2048
    while True:  # a header may have any length, as a url has
        head = get(at, n)
        if not head.startswith(VERSION):
            raise Invalid("version line")
        if b"\r\n\r\n" in head:
            break
        if len(head) < n:
            raise Invalid("header end")
        n *= 2
    size = head.index(b"\r\n\r\n")
    headers = _headers(head[:size])
    length = int(headers["content-length"])
    if at + size + 4 + length + 4 > end:
        raise Invalid("length")
    body = get(at + size + 4, length + 4)
    _checked(headers, body[:length], body[length:])
    return Record(offset, size + 4 + length + 4, headers, body[:length])


def _member(source: Source, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at `at`, where its reading ended, and what is wrong with it: what comes before a
    damage is kept."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    while not unpack.eof:
        chunk = source.get(pos, min(1 << 16, source.size - pos))
        if not chunk:
            return b"".join(out), pos, "member cut short"
        before = unpack.copy()
        try:
            out.append(unpack.decompress(chunk))
        except zlib.error:
            try:  # byte by byte up to the damage
                for i in range(len(chunk)):
                    out.append(before.decompress(chunk[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), pos + i, "gzip data"
        pos += len(chunk)
    return b"".join(out), pos - len(unpack.unused_data), ""


def _at(source: Source, at: int) -> tuple[list[Record], int | None, str]:
    """The records that start at `at` (a member may hold several), where they end (None where a damaged member's end is
    not known), and what is wrong with the member beside them."""
    head = source.get(at, 7)
    if head.startswith(GZIP):
        data, end, damage = _member(source, at)
        known = not damage
        found, pos = [], 0
        while 0 <= pos < len(data):
            try:
                r = _plain(lambda o, n: data[o : o + n], pos, at, len(data))
            except Invalid as why:
                damage = damage or str(why)
                pos = data.find(VERSION, pos + 1)
                continue
            pos += r.length
            r.length = end - at
            found.append(r)
        if not found:
            raise Invalid(damage or "empty member")
        return found, end if known else None, damage
    if head == VERSION:
        r = _plain(source.get, at, at, source.size)
        return [r], at + r.length, ""
    raise Invalid("no member or version line")


def salvage(source: Source) -> Iterator[Record | Gap]:
    """All valid records in order, and gaps that cover every other byte. A damaged gzip member is a gap too, after the
    records that were kept from it."""
    pos, gap, reason = 0, None, ""
    while pos < source.size:
        try:
            found, end, damage = _at(source, pos)
        except Invalid as why:
            if gap is None:
                gap, reason = pos, str(why)
            pos = _next_start(source, pos + 1)
            continue
        if gap is not None:
            yield Gap(gap, pos - gap, reason)
            gap = None
        yield from found
        if end is None:
            gap, reason = pos, damage
            pos = _next_start(source, pos + 1)
            continue
        if damage:
            yield Gap(pos, end - pos, damage)
        pos = end
    if gap is not None:
        yield Gap(gap, source.size - gap, reason)


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _next_start(source: Source, at: int) -> int:
    """Where the next gzip magic or version mark is, or the end."""
    while at < source.size:
        held = source.get(at, min(STEP, source.size - at))
        if m := _START.search(held):
            return at + m.start()
        if at + len(held) >= source.size:
            break
        at += max(1, len(held) - 6)
    return source.size


# --------------------------------------------------------------------------- on Spark


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html, refers_to) as archives of about archive_bytes in folder; path, records and bytes of each.

    The folder may be of any file system that Arrow reaches by its URI (local or mounted, HDFS, S3, GCS).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        filesystem, base = _open(folder)
        out, path, number, records = None, "", 0, 0

        def done() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    if not number:
                        filesystem.create_dir(base, recursive=True)
                    out, path, records = filesystem.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
                    number += 1
                out.write(gzip_member(page_record(page_id, url or "", (html or "").encode(), refers_to)))
                records += 1
                if out.tell() >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


RECORD = "path string, offset long, length long, status string, record_type string, record_id string, target_uri string, refers_to_id string, payload binary, payload_bytes long, payload_digest string"


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in paths(path), one row each, and a row with status `gap: reason` for each quarantined
    stretch. payload_bytes and payload_digest are those of the full payload, of revisits by what their headers say."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in RECORD.split(", ")]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as f:
                    size = f.size()
                    for r in salvage(Source(lambda at, n, f=f: f.read_at(n, at), size)):
                        rows.append((path, *_row(r, with_payload)))
                        held += r.length
                        if held > 8 << 20:
                            yield out()
                            rows, held = [], 0
        yield out()

    return paths.select("path").mapInArrow(run, RECORD)


def _row(r: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(r, Gap):
        return r.offset, r.length, f"gap: {r.reason}", None, None, None, None, None, None, None
    h = r.headers
    head, _, payload = r.block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", r.block)
    named = h.get("warc-payload-digest", "")
    if h["warc-type"] == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size, digest = int(said[1]) if said else None, base64.b32decode(named[5:]).hex() if named.startswith("sha1:") else None
        payload = None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    status = "ok" if h["warc-type"] == "revisit" or not named or named == "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() else "ok: payload digest differs"
    strip = lambda x: x.strip("<>") if x else None
    return r.offset, r.length, status, h["warc-type"], strip(h.get("warc-record-id")), h.get("warc-target-uri"), strip(h.get("warc-refers-to")), payload if with_payload else None, size, digest


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to: the page_id of the response for each page that revisits one. Of equal payloads
    (same SHA-1 and length) of at least `least` bytes that with the largest page_id is the response."""
    sized = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_size"))
    # Groups of one need no look-up, so what is joined holds repeated payloads only; one in a third of all pages is dealt out.
    repeated = sized.where((F.col("_size") >= least) & F.col("page_id").isNotNull()).groupBy("_sha", "_size").agg(F.max("page_id").alias("_last"), F.count("*").alias("n")).where("n > 1")
    repeated, _ = materialize(repeated, "warc-repeated")
    joined = join_dealt(sized, repeated, ["_sha", "_size"], "page_id", how="left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))


def split_gaps(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of read_archives(), and the quarantined gaps (path, offset, length, reason); what was read is kept in
    the shared folder, so the archives are read once. Gaps are logged by number and bytes."""
    read, _ = materialize(read, "warc-records")
    is_gap = F.col("status").startswith("gap: ")
    gaps = read.where(is_gap).select("path", "offset", "length", F.substring("status", 6, 1 << 20).alias("reason"))
    n, size = gaps.agg(F.count("*"), F.sum("length")).first()
    if n:
        logging.getLogger(__name__).warning("%d quarantined gaps of %d bytes", n, size)
    return read.where(~is_gap), gaps


def all_back(written: DataFrame, records: DataFrame) -> DataFrame:
    """records; fails if there are not as many as were written."""
    want, got = written.agg(F.sum("records")).first()[0] or 0, records.count()
    if got != want:
        raise RuntimeError(f"{want} records were written, {got} came back")
    return records


def op6_warc_salvage(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    written, _ = materialize(write_archives(with_revisits(pages), shared_path(spark, "warc"), 32 << 20), "warc-archives")
    read, _ = split_gaps(read_archives(written.repartition(max(1, written.count())), with_payload=False))
    read = all_back(written, read)
    number = lambda c: F.expr(f"try_cast(nullif(substring_index({c}, ':', -1), '') as bigint)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "target_uri")
