"""WARC archives as chunked record tables.

Writing: each task writes gzip members, one per record, feeding a payload to the compressor piece by
piece.  Reading: each task streams a file and yields rows (record, chunk number, bytes, running digest),
so no record is ever held whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope.llm.common import ROW_KEY, stored, with_ids, with_row_key
from themescope.session import scratch_path

#: Bytes of a payload in one row of the record table.
CHUNK_BYTES = 1 << 16
#: A file is closed at the end of the record that takes it beyond this.
FILE_BYTES = 256 << 20
_READ_BYTES = 1 << 18
_STAMP = "1970-01-01T00:00:00Z"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path, on whichever machine runs this."""
    return pafs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}")


def record_id(key) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}"


def _header(kind: str, key, url: str | None, length: int, digest: str, size: int, refers_to) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(key)}>", f"WARC-Date: {_STAMP}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or "urn:unknown"),
        "Content-Type: application/octet-stream", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {length}", f"Page-Key: {key}", f"Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{record_id(refers_to)}>", f"Refers-To-Key: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def write_archives(pages: DataFrame, folder: str, payload_col: str, url_col: str, refers_col: str,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (with its ``_k``) below ``folder``; the stored table of files.

    A row whose ``refers_col`` is set becomes a revisit record without payload.  A task that runs twice
    writes other file names; only files named in the returned table count.
    """
    def run(batches):
        out = name = None
        size = count = 0
        for batch in batches:
            keys = batch.column(ROW_KEY).to_pylist()
            urls = batch.column(url_col).to_pylist()
            refers = batch.column(refers_col).to_pylist()
            payloads = batch.column(payload_col)
            for i, key in enumerate(keys):
                raw = payloads[i].as_buffer()
                data = memoryview(raw) if raw is not None else memoryview(b"")
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                digest = hashlib.sha1()
                for at in range(0, len(data), CHUNK_BYTES):
                    digest.update(data[at: at + CHUNK_BYTES])
                revisit = refers[i] is not None
                body = 0 if revisit else len(data)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                head = _header("revisit" if revisit else "response", key, urls[i], body, _b32(digest.digest()),
                               len(data), refers[i])
                size += out.write(member.compress(head)) or 0
                for at in range(0, body, CHUNK_BYTES):
                    piece = member.compress(data[at: at + CHUNK_BYTES])
                    out.write(piece)
                    size += len(piece)
                piece = member.compress(b"\r\n\r\n") + member.flush()
                out.write(piece)
                size += len(piece)
                count += 1
                if size >= file_bytes:
                    out.close()
                    yield _files(folder, name, count, size)
                    out = None
        if out is not None:
            out.close()
            yield _files(folder, name, count, size)

    wide = pages.select(ROW_KEY, url_col, refers_col, payload_col)
    return stored(wide.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def _files(folder: str, name: str, count: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
        names=["path", "records", "bytes"])


class _Records:
    """Splits a stream of inflated bytes into headers and payload chunks."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes, self.held = chunk_bytes, bytearray()
        self.header: dict[str, str] | None = None
        self.left = self.chunk = self.seen = self.skip = 0
        self.digest = hashlib.sha1()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
        self.held += data
        while True:
            if self.skip:
                gone = min(self.skip, len(self.held))
                del self.held[:gone]
                self.skip -= gone
                if self.skip:
                    return
            if self.header is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode("utf-8", "surrogatepass").split("\r\n")
                self.header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                del self.held[:end + 4]
                self.left, self.chunk, self.seen = int(self.header["content-length"]), 0, 0
                self.digest = hashlib.sha1()
            take = min(self.left, self.chunk_bytes)
            if len(self.held) < take:
                return
            piece = bytes(self.held[:take])
            del self.held[:take]
            self.digest.update(piece)
            self.left -= take
            self.seen += take
            done = self.left == 0
            yield self.header, self.chunk, piece, self.seen, _b32(self.digest.digest()), done
            self.chunk += 1
            if done:
                self.header, self.skip = None, 4


RECORD_TABLE = ("record_id string, page_key long, record_type string, refers_to_key long, url string, "
                "stated_digest string, stated_bytes long, chunk_no int, chunk binary, bytes_so_far long, "
                "digest_so_far string, last boolean")


def read_records(files: DataFrame, path_col: str = "path", chunk_bytes: int = CHUNK_BYTES,
                 with_bytes: bool = True) -> DataFrame:
    """The chunked record table of archives: a row per record and chunk, in order of the chunk number.

    ``bytes_so_far`` and ``digest_so_far`` (SHA-1) cover the payload up to and including the chunk, so the
    row with ``last`` carries the whole record's.  A record without payload has one empty chunk.
    """
    def run(batches):
        for batch in batches:
            for path in batch.column(path_col).to_pylist():
                system, inner = _open(path)
                records, rows, held = _Records(chunk_bytes), [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    member = zlib.decompressobj(31)
                    while data := stream.read(_READ_BYTES):
                        while data:
                            plain = member.decompress(data, _READ_BYTES)
                            data = member.unconsumed_tail
                            if member.eof:
                                data = member.unused_data
                                member = zlib.decompressobj(31)
                            for header, no, piece, seen, digest, done in records.feed(plain):
                                rows.append(_row(header, no, piece if with_bytes else None, seen, digest, done))
                                held += len(piece) + 500
                                if held > 4 << 20:
                                    yield _table(rows)
                                    rows, held = [], 0
                if rows:
                    yield _table(rows)

    return files.select(path_col).mapInArrow(run, RECORD_TABLE)


def _row(header, no, piece, seen, digest, done):
    number = lambda name: int(header[name]) if name in header else None
    return (header["warc-record-id"].strip("<>"), number("page-key"), header["warc-type"], number("refers-to-key"),
            header.get("warc-target-uri"), header.get("warc-payload-digest", "").removeprefix("sha1:"),
            number("payload-length"), no, piece, seen, digest, done)


_ARROW = pa.schema([
    ("record_id", pa.string()), ("page_key", pa.int64()), ("record_type", pa.string()), ("refers_to_key", pa.int64()),
    ("url", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int32()),
    ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])


def _table(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
            min_bytes: int = 0) -> tuple[DataFrame, tuple[DataFrame, bool]]:
    """Write the archives of ``pages``; the table of files, and the keyed pages.

    Of rows with equal payloads of at least ``min_bytes`` that with the largest id becomes the response,
    the others revisit it; shorter ones are all responses.  Repeated ids are told apart by payload, so of
    rows that agree in everything one is the response; a missing id counts as smallest.

    Digests are counted first (combined in each task), and only those that occur twice, a stored table of
    known size, are joined to the pages; Spark broadcasts it when small and splits hot digests when not.
    """
    keyed = with_row_key(pages, id_col, payload_col, url_col)
    rows = keyed[0].select(ROW_KEY, url_col, F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = stored(
        rows.filter(F.length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max(ROW_KEY).alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-digests")
    linked = rows.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when(F.col("response") != F.col(ROW_KEY), F.col("response")))
    return write_archives(linked, folder, "payload", url_col, "refers_to"), keyed


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
               url_col: str = "url", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` and read the archives back: id_col, payload_bytes, payload_digest, record_type,
    refers_to, chunks.

    Response rows carry the length and digest that were computed while reading; a revisit carries those
    its header states.  Missing payloads are empty; an empty table gives no file and no row; extra columns
    are not looked at.
    """
    files, keyed = archive(pages, folder or scratch_path(spark, "warc"), id_col, payload_col, url_col, min_bytes)
    spread = files.repartition(max(1, files.count()))
    last = read_records(spread, with_bytes=False).filter("last")
    revisit = F.col("record_type") == "revisit"
    result = last.select(
        F.col("page_key").alias(ROW_KEY),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type", F.col("refers_to_key").alias("refers"), (F.col("chunk_no") + 1).alias("chunks"))
    if keyed[1]:
        names = keyed[0].select(F.col(ROW_KEY).alias("refers"), F.col(id_col).alias("refers_to"))
        result = result.join(names, "refers", "left").drop("refers")
    else:
        result = result.withColumnRenamed("refers", "refers_to")
    return with_ids(result, keyed, id_col).select(
        id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks")
