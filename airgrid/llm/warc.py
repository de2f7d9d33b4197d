"""WARC archives from a chunked record table, and back.

A payload travels as rows (record, chunk number, bytes) of CHUNK bytes at most: the writer streams them into one gzip member per
record and carries the SHA-1 along; the reader streams the members and yields the same rows, each with the digest so far. No
record is ever held whole on the Python side. Of records with equal payloads (of min_bytes at least) that with the smallest
page_id is a response, the others are revisits that name it; equal payloads are found by SHA-1 and length in one aggregate.

Archives are written by tasks under names of their own and listed in a manifest that Spark commits.

Null html is an empty payload; null url an empty target; a null page_id sorts behind all others and is written as a record
without an id. Rows repeated with the smallest page_id of their payload are all responses. An empty table gives no record.
Columns but page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm import _store

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "file string, records long, bytes long"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode().rstrip("=")


def record_id(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str) -> int | None:
    return None if record == "<urn:page:none>" else int(record.removeprefix("<urn:page:").removesuffix(">"))


def mark(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (bytes), n_bytes, sha1 (hex), refers_to (null: a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    groups = _store.written(groups.where(F.col("n") > 1).drop("n"), "warc-groups")
    later = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    if _store.small(groups):
        joined = rows.join(F.broadcast(groups), ["sha1", "n_bytes"], "left")
        return joined.withColumn("refers_to", F.when(later, F.col("first_page"))).drop("first_page")
    # payloads must not meet by digest, of which one may be commonest by far: revisits are found without payloads, which they do not
    # need, and what is left of the rows is told by page
    again = rows.drop("payload").join(groups, ["sha1", "n_bytes"]).where(later).withColumnRenamed("first_page", "refers_to")
    again = _store.written(again, "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("again_page")) & (F.col("sha1") == F.col("again_sha1"))
    first = rows.join(again.select(F.col("page_id").alias("again_page"), F.col("sha1").alias("again_sha1")), same, "left_anti")
    return first.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again.withColumn("payload", F.lit(b"")))


def chunked(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table: one row per chunk, in order within a record; a revisit or an empty payload has one row without bytes."""
    n = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.floor((F.col("n_bytes") - 1) / chunk)).cast("int")
    out = marked.select("page_id", "url", "n_bytes", "sha1", "refers_to", "payload", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return out.select("page_id", "url", "n_bytes", "sha1", "refers_to", "chunk_no", data.alias("data"))


class Writer:
    """Streams records into one archive; a gzip member each."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.level, self.bytes = sink, level, 0

    def begin(self, page_id, url: str, n_bytes: int, sha1: str, refers_to) -> None:
        revisit = refers_to is not None
        self.digest, self.want = hashlib.sha1(), None if revisit else sha1
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}", f"X-Payload-Length: {n_bytes}"]
        if revisit:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        head.append(f"Content-Length: {len(HTTP) + (0 if revisit else n_bytes)}")
        self.gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._out(self.gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + HTTP))

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self._out(self.gz.compress(data))

    def end(self) -> None:
        if self.want is not None and self.digest.hexdigest() != self.want:
            raise ValueError("the payload differs from its digest")
        self._out(self.gz.compress(b"\r\n\r\n") + self.gz.flush())

    def _out(self, raw: bytes) -> None:
        if raw:
            self.sink.write(raw)
            self.bytes += len(raw)


class _Members:
    """The bytes of concatenated gzip members, as a stream of which little is held."""

    def __init__(self, source):
        self.source, self.z, self.held, self.over = source, zlib.decompressobj(31), b"", False
        self.rest = b""

    def fill(self, n: int) -> None:
        while len(self.held) < n and not self.over:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                self.over = True
                return
            self.held += self.z.decompress(raw, CHUNK)
            if self.z.eof:
                self.rest = self.z.unused_data
                self.z = zlib.decompressobj(31)
            else:
                self.rest = self.z.unconsumed_tail

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def until(self, mark: bytes) -> bytes:
        n = 1024
        while mark not in self.held and not self.over:
            self.fill(n)
            n += 1024
        at = self.held.find(mark)
        if at < 0:
            out, self.held = self.held, b""
            return out
        return self.take(at + len(mark))


def read_chunks(source, chunk: int = CHUNK):
    """(headers, chunk number, bytes, SHA-1 so far, last) of every record of an archive."""
    stream = _Members(source)
    while True:
        head = stream.until(b"\r\n\r\n")
        if not head.strip():
            return
        lines = head.decode().strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        left = int(fields["Content-Length"]) - len(stream.until(b"\r\n\r\n"))
        digest, k = hashlib.sha1(), 0
        while True:
            data = stream.take(min(chunk, left))
            left -= len(data)
            if left and not data:
                raise ValueError("a record is cut off")
            digest.update(data)
            yield fields, k, data, digest.digest(), left == 0
            k += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every record; returns the committed manifest."""

    def run(batches):
        fs, base = _store.filesystem(out)
        fs.create_dir(base, recursive=True)
        sink, writer, name, n, open_record = None, None, "", 0, False
        done = []

        def close():
            sink.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [writer.bytes]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for row in range(b.num_rows):
                page, url, size, sha1, refers, k, data = (c[row] for c in b.columns)
                if k.as_py() == 0:
                    if open_record:
                        writer.end()
                        open_record = False
                        if writer.bytes >= archive_bytes:
                            done.append(close())
                            sink = None
                    if sink is None:
                        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = fs.open_output_stream(f"{base}/{name}")
                        writer = Writer(sink)
                    writer.begin(page.as_py(), url.as_py(), size.as_py(), sha1.as_py(), refers.as_py())
                    n, open_record = n + 1, True
                writer.chunk(data.as_py())
            yield from done
            done.clear()
        if open_record:
            writer.end()
        if sink is not None:
            yield close()

    return _store.written(chunked(mark(pages, min_bytes)).mapInArrow(run, MANIFEST), "warc-manifest")


def _from_files(manifest: DataFrame, out: str, each, schema: str) -> DataFrame:
    def run(batches):
        fs, base = _store.filesystem(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as f:
                    yield from each(io.BufferedReader(f, CHUNK) if isinstance(f, io.RawIOBase) else f)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(n, "file").mapInArrow(run, schema)


def chunk_table(manifest: DataFrame, out: str) -> DataFrame:
    """The archives as the record table they came from: record_id, chunk_no, data, sha1_so_far, last."""
    names = ["record_id", "chunk_no", "data", "sha1_so_far", "last"]

    def each(f):
        for fields, k, data, digest, last in read_chunks(f):
            yield pa.record_batch([pa.array([fields["WARC-Record-ID"]]), pa.array([k], pa.int64()), pa.array([data], pa.binary()), pa.array([digest], pa.binary()), pa.array([last])], names=names)

    return _from_files(manifest, out, each, "record_id string, chunk_no long, data binary, sha1_so_far binary, last boolean")


def records(manifest: DataFrame, out: str) -> DataFrame:
    """One row per record read back, its payload checked against its digest as it streams by."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def each(f):
        rows, size = [], 0
        for fields, _, data, digest, last in read_chunks(f):
            size += len(data)
            if not last:
                continue
            kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (base32_sha1(digest) != said or size != int(fields["X-Payload-Length"])):
                raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
            refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
            rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), said, kind, refers))
            size = 0
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return _from_files(manifest, out, each, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
