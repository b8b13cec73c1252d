"""Deterministic sharded WARC writer.

Rows of (page_id, url, html) stand in one order: url, page_id, digest of the row. The running sum of their bytes over that
order, divided by ``SHARD_BYTES``, is the shard; it comes from the whole table, so shards don't depend on how the input
is split or on the number of executors. A task writes a shard: records in order, one gzip member each, into files that are
closed before a record would take them past ``FILE_BYTES`` compressed bytes. Headers, record ids and digests are made anew
from the content, and the date is a parameter, so the same table always gives the same bytes.

A file is written under a temporary name of its own attempt, summed as it is written, and then renamed; a repeated or
speculative attempt makes the same bytes under the same name, and where that is taken already its own copy goes. When all shards are written, the driver writes ``manifest.json`` (files, sizes,
records, SHA-256), likewise by renaming: a folder without it isn't complete, and files that it doesn't list aren't part
of the output.

The folder is a URI that pyarrow's file systems know, ``s3a`` being read as ``s3``; any other fails before a row is read.

Defined results: nulls sort first; a null url is written as ``urn:page:<page_id>``; characters that a header can't hold are
percent-encoded in both; a null html is an empty payload; rows equal in all three columns stand side by side with ids of their
own; a record larger than ``FILE_BYTES`` has a file to itself; an empty table gives a manifest without files; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcgraph.llm import common as C

SHARD_BYTES, FILE_BYTES, DATE = 64 << 20, 16 << 20, "2024-01-01T00:00:00Z"
_SAFE = "".join(map(chr, range(33, 127)))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def target_uri(url: str | None, page_id) -> str:
    return urllib.parse.quote(url, safe=_SAFE) if url is not None else f"urn:page:{urllib.parse.quote(str(page_id), safe=_SAFE)}"


def response(url: str | None, page_id, html: str | None, again: int, date: str) -> tuple[bytes, str, str]:
    """(record, its id, its payload's digest); ``again``: how many equal rows came before."""
    payload = (html or "").encode()
    digest = _sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    uri = target_uri(url, page_id)
    rid = f"<urn:uuid:{uuid.UUID(hashlib.sha256(json.dumps([uri, str(page_id), html is None, digest, again]).encode()).hexdigest()[:32])}>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: {digest}\r\nWARC-Block-Digest: {_sha1(block)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n", rid, digest


def info(name: str, date: str) -> bytes:
    block = b"software: srcgraph\r\nformat: WARC File Format 1.0\r\n"
    rid = f"<urn:uuid:{uuid.UUID(hashlib.sha256(name.encode()).hexdigest()[:32])}>"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nWARC-Block-Digest: {_sha1(block)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def located(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


class _Files:
    """The files of one shard, in order; ``done``: (name, bytes, records, SHA-256) of those that are closed."""

    def __init__(self, folder: str, shard: int, date: str, limit: int, attempt: str):
        self.fs, self.path = located(folder)
        self.done: list[tuple[str, int, int, str]] = []
        self.shard, self.date, self.limit, self.attempt = shard, date, limit, attempt
        self.number, self.out = -1, None

    def add(self, record: bytes) -> tuple[str, int, int]:
        """(file, offset, length)"""
        m = _member(record)
        if self.out is not None and self.size + len(m) > self.limit and self.records:
            self.close()
        if self.out is None:
            self.number += 1
            self.name = f"pages-{self.shard:08d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.path}/.{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._put(_member(info(self.name, self.date)))
        at = self.size
        self._put(m)
        self.records += 1
        return self.name, at, len(m)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            at = f"{self.path}/{self.name}"
            try:
                self.fs.move(self.temp, at)
            except OSError:
                if self.fs.get_file_info(at).size != self.size:  # not the same bytes of another attempt
                    raise
                self.fs.delete_file(self.temp)
            self.done.append((self.name, self.size, self.records, self.sum.hexdigest()))
            self.out = None


_INDEX = ["page_id", "url", "warc_file", "file_offset", "record_length", "record_id", "payload_digest"]


def _writer(folder: str, date: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each record; and for each file one with offset -1, the number of records as its length, and the file's bytes and SHA-256 as id and digest."""

    def closed(files: _Files, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        files.close()
        if files.done:
            n = len(files.done)
            name, size, records, digest = zip(*files.done)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.array(name), pa.array([-1] * n, pa.int64()), pa.array(records, pa.int64()), pa.array(map(str, size), pa.string()), pa.array(digest)], names=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files, last, again, kinds = None, None, 0, []
        for b in batches:
            rows, kinds = [], [b.column(1).type, b.column(2).type]
            for shard, page_id, url, html in zip(*(c for c in b.columns)):
                shard, page_id, url, html = shard.as_py(), page_id.as_py(), url.as_py(), html.as_py()
                if files is None or files.shard != shard:
                    if files is not None:
                        yield from closed(files, kinds)
                    files, last = _Files(folder, shard, date, limit, attempt), None
                again = again + 1 if last == (page_id, url, html) else 0
                last = (page_id, url, html)
                record, rid, digest = response(url, page_id, html, again, date)
                rows.append((page_id, url, *files.add(record), rid, digest))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5]), pa.array(cols[6])], names=_INDEX)
        if files is not None:
            yield from closed(files, kinds)

    return run


def _identity() -> Column:
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-"))
    return F.md5(F.concat_ws("|", part("page_id"), part("url"), part("html")).cast("binary"))


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` to ``folder`` (a URI that all executors share) and return each record's place: page_id, url, warc_file, file_offset, record_length, record_id, payload_digest."""
    base, path = located(folder)
    base.create_dir(path, recursive=True)
    pages = pages.select("page_id", "url", "html")
    keys = pages.select("page_id", "url", _identity().alias("id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("long").alias("size"))
    keys = keys.groupBy("url", "page_id", "id").agg(F.sum("size").alias("size"))
    order = ["url", "page_id", "id"]
    keys = C.cut(keys.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    before = keys.groupBy("part").agg(F.sum("size").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.withColumn("upto", F.sum("size").over(within) - F.col("size")).join(F.broadcast(before), "part")
    placed = C.cut(placed.select("id", ((F.col("upto") + F.col("before")) / F.lit(shard_bytes)).cast("long").alias("shard")))
    rows, last = placed.agg(F.count("*"), F.max("shard")).first()
    shards = (last or 0) + 1
    small = F.broadcast(placed) if rows * 64 <= C.BROADCAST_BYTES else placed
    n = min(shards, 100_000)
    records = pages.withColumn("id", _identity()).join(small, "id").repartitionById(n, (F.col("shard") * n / shards).cast("int")).sortWithinPartitions("shard", *order)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, warc_file string, file_offset long, record_length long, record_id string, payload_digest string"
    written = C.cut(records.select("shard", "page_id", "url", "html").mapInArrow(_writer(folder, date, file_bytes), schema))
    _commit(written.filter("file_offset < 0"), folder)
    return written.filter("file_offset >= 0")


def _commit(files: DataFrame, folder: str) -> None:
    """The manifest has one line for each file; it grows with the files, not with the records."""
    files = files.select(F.col("warc_file").alias("file"), F.col("record_length").alias("records"), F.col("record_id").cast("long").alias("bytes"), F.col("payload_digest").alias("sha256"))
    at, path = located(folder)
    temp = f"{path}/.manifest.{uuid.uuid4().hex}"
    with at.open_output_stream(temp, compression=None) as out:
        out.write(b'{"format": "WARC/1.0", "files": [')
        for i, r in enumerate(files.orderBy("file").toLocalIterator()):
            out.write(("," * (i > 0) + "\n" + json.dumps(r.asDict())).encode())
        out.write(b"\n]}\n")
    at.move(temp, f"{path}/manifest.json")


def read_warc(data: bytes) -> list[tuple[int, dict, bytes]]:
    """(offset, headers, block) of each record of a file."""
    out, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:])
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        assert lines[0] == "WARC/1.0" and rest[n:] == b"\r\n\r\n"
        out.append((at, headers, rest[:n]))
        at = len(data) - len(z.unused_data)
    return out


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_warc(C.table(spark, sf_dir, "pages"), _uri(C.scratch(spark, "warc")))


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
