"""WARC archives: one gzip member per record, written by executors and read back by a sequential reader.

Writer: pages are dealt by a hash into archives of about ``ARCHIVE_BYTES``, each archive goes to a file of its own in a shared
folder under a temporary name and is then renamed, so a repeated task replaces it with the same bytes. Payloads that occur more than
once become ``revisit`` records of the page with the largest id.

Reader: streams a file, inflates member by member, frames each record by its Content-Length and checks block and payload
digests. Memory holds one record at a time.

Defined cases: a null html is an empty payload; a null url is written as ``urn:none``; payloads below ``least`` bytes
are always responses; among equal payloads rows without page_id revisit the largest id, and are all responses if
there is none; rows that repeat the largest id are all responses; no pages give no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, shuffle_width, stored

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: Payload bytes that an archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()] + [f"{k}: {v}".encode() for k, v in headers]
    lines += [f"WARC-Block-Digest: {sha1_label(block)}".encode(), f"Content-Length: {len(block)}".encode(), b"", b""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(CRLF.join(lines)) + pack.compress(block) + pack.compress(CRLF + CRLF) + pack.flush()


def name(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_record(page_id, url, payload: bytes, refers_to) -> bytes:
    url = "urn:none" if url is None else "".join(c if c.isprintable() and c != " " else f"%{b:02X}" for c in url for b in [ord(c) & 255])
    headers = [("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
               ("WARC-Payload-Digest", sha1_label(payload)), ("X-Payload-Bytes", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", headers + [("Content-Type", "application/http;msgtype=response")], http + payload)
    headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record("revisit", headers + [("Content-Type", "application/http;msgtype=response")], http)


def _writer(folder: str):
    def write(pages: pa.Table, again: pa.Table) -> pa.Table:
        if not pages.num_rows:
            return pa.Table.from_pylist([], schema=MANIFEST)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        archive, temporary = pages.column("archive")[0].as_py(), f"{root}/.{uuid.uuid4().hex}"
        first = {(p, d): r for p, d, r in zip(*(again.column(c).to_pylist() for c in ("page_id", "digest", "refers_to")))}
        info = record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{archive}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        size = len(info)
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(info)
            pages = pages.sort_by([("page_id", "ascending"), ("digest", "ascending")])
            for page_id, url, html, digest in zip(*(pages.column(c) for c in ("page_id", "url", "html", "digest"))):
                page_id = page_id.as_py()
                made = page_record(page_id, url.as_py(), html.as_py().encode(), first.get((page_id, digest.as_py())))
                out.write(made)
                size += len(made)
        fs.move(temporary, f"{root}/pages-{archive:06d}.warc.gz")
        return pa.Table.from_pylist([{"archive": archive, "path": f"{folder}/pages-{archive:06d}.warc.gz", "records": pages.num_rows, "bytes": size}], schema=MANIFEST)
    return write


MANIFEST = pa.schema([("archive", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page to an archive in ``folder`` and returns the manifest: archive, path, records, bytes."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    keys = stored(pages.select("page_id", "digest", F.octet_length("html").cast("long").alias("n")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    archives = max(1, -(-total // archive_bytes))
    large = keys.where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    archive = F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)).alias("archive")
    again = (large.join(first, "digest").where("refers_to IS NOT NULL AND NOT page_id <=> refers_to")
             .select("page_id", "digest", "refers_to").distinct().select("page_id", "digest", "refers_to", archive))
    # The pages cross the network once, to their archive, and meet there what they revisit.
    dealt = pages.select("page_id", "url", "html", "digest", archive).groupBy("archive").cogroup(again.groupBy("archive"))
    return stored(dealt.applyInArrow(_writer(folder), "archive long, path string, records long, bytes long"))


class Reader:
    """Reads one archive from start to end. ``source`` has read(n)."""

    def __init__(self, source, chunk: int = 1 << 16):
        self.source, self.chunk, self.raw = source, chunk, b""

    def members(self):
        """For each gzip member a reader of its bytes; the member is drained before the next one starts."""
        while True:
            if not self.raw:
                self.raw = self.source.read(self.chunk)
                if not self.raw:
                    return
            member = _Member(self)
            yield member
            member.drain()

    def records(self):
        """(headers, block) of every record, checked against its length and digests."""
        for member in self.members():
            head = member.until(CRLF + CRLF)
            lines = head.decode().split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            block = member.exactly(int(headers["Content-Length"]))
            if member.exactly(4) != CRLF + CRLF or member.some():
                raise ValueError("the record does not end where its Content-Length says")
            if headers.get("WARC-Block-Digest", sha1_label(block)) != sha1_label(block):
                raise ValueError(f"block digest differs: {headers.get('WARC-Record-ID')}")
            yield headers, block


class _Member:
    def __init__(self, reader: Reader):
        self.reader, self.inflate, self.ready = reader, zlib.decompressobj(31), bytearray()

    def some(self) -> bool:
        """Inflates until there are bytes; False at the end of the member."""
        while not self.ready:
            if self.inflate.eof:
                return False
            r = self.reader
            data = self.inflate.unconsumed_tail or r.raw or r.source.read(r.chunk)
            if not data:
                raise ValueError("the archive ends within a record")
            r.raw = b""
            self.ready += self.inflate.decompress(data, r.chunk)
            if self.inflate.eof:
                r.raw = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        out = bytearray()
        while mark not in out:
            if not self.some():
                raise ValueError("a record without headers")
            out += self.ready
            self.ready.clear()
        at = out.index(mark)
        self.ready += out[at + len(mark):]
        return bytes(out[:at])

    def exactly(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not self.some():
                raise ValueError("a record is shorter than its Content-Length")
            take = self.ready[:n - len(out)]
            del self.ready[:len(take)]
            out += take
        return bytes(out)

    def drain(self) -> None:
        while self.some():
            self.ready.clear()


def _page_id(urn: str | None):
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "none") else None


def parse_pages(source):
    """Page rows of one archive; the payload's digest is computed from its bytes, for a revisit taken from its header."""
    for headers, block in Reader(source).records():
        kind = headers["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        payload = block.split(CRLF + CRLF, 1)[1]
        label, size = headers["WARC-Payload-Digest"], int(headers["X-Payload-Bytes"])
        if kind == "response":
            if sha1_label(payload) != label or len(payload) != size:
                raise ValueError(f"payload digest differs: {headers['WARC-Record-ID']}")
        digest = base64.b32decode(label.removeprefix("sha1:")).hex()
        yield {"page_id": _page_id(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": kind,
               "refers_to": _page_id(headers.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest,
               "payload": payload.decode() if kind == "response" else None}


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])


def _reader(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, local = filesystem(path)
            rows, held = [], 0
            with fs.open_input_stream(local, compression=None) as source:
                for row in parse_pages(source):
                    rows.append(row)
                    held += row["payload_bytes"]
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=PAGES)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PAGES)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every page record of the archives that the manifest lists."""
    paths = manifest.select("path").repartition(shuffle_width(spark), "path")
    return paths.mapInArrow(_reader, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, shared_folder(spark), least))
