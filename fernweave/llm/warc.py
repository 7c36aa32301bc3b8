"""WARC archives: writing, the gzip normaliser with its sidecar index, and reading by offset.

`write_archives` writes monolithic archives (one gzip stream over all records of a file).
`normalise` inflates each such stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of (offset, length, record id) a line beside it. `read_records` then
reads members by their offsets. Records of equal payloads are stored once: that of the smallest
page_id is a `response`, the others are `revisit` records that refer to it.

Files are written under a name of the attempt and then renamed, and only files that a manifest
names are read, so tasks may run twice or die half-way. Memory holds one record and one gzip buffer.

Defined cases: null html is an empty payload; a null url is an empty target; rows of one page_id
are one record each, and among equal ids and payloads every row of the smallest id is a response;
a null page_id sorts last; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, fresh_dir, read, written

LEVEL, FILE_BYTES = 4, 128 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(folder: str):
    """(file system, path) for a folder given as a URI or a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def local_uri(folder: str) -> str:
    """file:/x and file:///x alike."""
    return "file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with `first`, the smallest page_id of an equal payload of min_bytes or more.

    The count of equal payloads is summed map-side; only payloads that occur more than once are
    joined back, and that join can be split where one payload has many pages.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("_k"), F.octet_length(body).alias("_n"))
    again = keyed.where(F.col("_n") >= min_bytes).groupBy("_k").agg(F.min("page_id").alias("first"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    return keyed.join(again, "_k", "left").select("page_id", "url", "html", "first")


def record(page_id: int | None, url: str | None, html: str | None, first: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    revisit = first is not None and page_id != first
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """One file, written under another name until it is whole."""

    def __init__(self, folder: str, name: str):
        import uuid

        self.fs, base = store(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path, self.part = name, f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.at = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Monolithic archives of rows (page_id, url, html, first); returns (name, records), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        out = gz = None
        raw = n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out, gz, raw, n = Writer(folder, f"mono-{uuid.uuid4().hex}.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = record(*(batch.column(c)[i].as_py() for c in range(4)))
                out.write(gz.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= file_bytes:
                    out.write(gz.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})

    return written(rows.select("page_id", "url", "html", "first").mapInArrow(run, "name string, records long"), "warc-list")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated bytes of one or more gzip members in a row."""
    z = zlib.decompressobj(31)
    for data in chunks:
        while data:
            got = z.decompress(data, 1 << 20)
            if got:
                yield got
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    rest = z.flush() if not z.eof else b""
    if rest:
        yield rest


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records out of inflated bytes, by their Content-Length."""
    buf, need, at = bytearray(), -1, 0
    for got in stream:
        buf += got
        while True:
            if need < 0:
                end = buf.find(b"\r\n\r\n", max(0, at - 3))
                if end < 0:
                    at = len(buf)
                    break
                need, at = end + 4 + int(header(bytes(buf[:end]))["content-length"]) + 4, 0
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need, at = -1, 0
    if buf:
        raise ValueError(f"the archive ends inside a record, {len(buf)} bytes after the last whole one")


def header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(names: DataFrame, folder: str, level: int = LEVEL, drop: bool = True) -> DataFrame:
    """Each archive again with a member a record, and its sidecar `.idx`; returns (name, records), written.

    An archive is one task's work, so a task's work is bounded by `file_bytes`, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = store(folder)
                out, idx = Writer(folder, name.replace("mono-", "norm-")), io.StringIO()
                n = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as src:
                    for data in split_records(inflate(iter(lambda: src.read(1 << 20), b""))):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        began = out.at
                        out.write(gz.compress(data) + gz.flush())
                        rid = header(data[: data.find(b"\r\n\r\n")])["warc-record-id"]
                        idx.write(json.dumps([began, out.at - began, rid]) + "\n")
                        n += 1
                out.close()
                side = Writer(folder, out.name + ".idx")
                side.write(idx.getvalue().encode())
                side.close()
                yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})

    count = max(1, names.count())
    done = written(names.select("name").repartition(count, "name").mapInArrow(run, "name string, records long"), "warc-norm")
    if drop:  # the monolithic files are of no more use, now that the list of new ones is kept
        spark = names.sparkSession
        for path in spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/mono-*")) or []:
            path.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getPath(), False)
    return done


def read_records(names: DataFrame, folder: str) -> DataFrame:
    """One row a record, each read as a member of its own at the offset that the index gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = store(folder)
                with fs.open_input_file(f"{base}/{name}") as src, fs.open_input_stream(f"{base}/{name}.idx", compression=None) as side:
                    rows = []
                    for line in side.read().decode().splitlines():
                        began, length, rid = json.loads(line)
                        rows.append(parsed(zlib.decompress(src.read_at(length, began), 31), rid))
                        if len(rows) == 4096:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    return names.select("name").mapInArrow(run, OUT)


def parsed(data: bytes, rid: str) -> tuple:
    cut = data.find(b"\r\n\r\n")
    h = header(data[:cut])
    if h["warc-record-id"] != rid:
        raise ValueError(f"the index names {rid}, the record at its offset is {h['warc-record-id']}")
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None  # noqa: E731  <urn:page:N>
    if h["warc-type"] == "revisit":
        return number(rid), int(h["x-payload-length"]), h["warc-payload-digest"][5:], "revisit", number(h["warc-refers-to"])
    block = data[cut + 4 : -4]
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    if "sha1:" + digest(payload) != h["warc-payload-digest"]:
        raise ValueError(f"the payload of {rid} doesn't have its digest")
    return number(rid), len(payload), digest(payload), "response", None


def table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages to normalised archives in folder and returns their list (name, records)."""
    mono = write_archives(marked(pages, min_bytes), folder, file_bytes)
    norm = normalise(mono, folder)
    drop_written(mono)
    return norm


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = local_uri(fresh_dir(spark, "warc"))
    names = archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_records(names.repartition(max(1, names.count()), "name"), folder)


__all__ = ["archive", "inflate", "marked", "normalise", "read_records", "split_records", "write_archives"]
