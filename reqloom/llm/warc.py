"""WARC archives: writing, normalising monolithic gzip files, reading back.

An archive written as one gzip stream can't be entered in its middle. The
normaliser inflates such a stream once, from begin to end in bounded memory,
rewrites each record as a gzip member of its own and writes a sidecar with
each member's offset and length. Readers then take single records by seeking.

Files are named by attempt; a task returns the names it wrote, and only names
returned by tasks that succeeded are read on. So what a lost executor left half
written is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import delete_path, scratch_path, ship, table, written

#: Uncompressed bytes after which a task begins another archive, gzip level, bytes read or inflated at a time.
ARCHIVE_BYTES, LEVEL, BLOCK = 64 << 20, 4, 1 << 20
#: Revisits up to this number (16 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Tasks, at most, among which archives are dealt.
MOST_TASKS = 20_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, but its digest and length."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Full-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A whole record's fields as the reader returns them; ValueError if its payload isn't what it says."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"record {page}: payload and digest differ")
    target = fields.get("WARC-Refers-To")
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": len(payload) if kind == "response" else int(fields["WARC-Full-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(target[len("<urn:page:") : -1]) if target else None,
    }


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """Blocks of what a gzip file of one or more members holds.

    ValueError if the last member has no end with its check sum, or if what
    follows a member isn't another one.
    """
    inflate, begun = zlib.decompressobj(31), False
    while data := stream.read(BLOCK):
        while data:
            begun = True
            try:
                out = inflate.decompress(data, BLOCK)
            except zlib.error as error:
                raise ValueError(f"the archive isn't whole gzip members: {error}") from error
            if out:
                yield out
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
            else:
                data = inflate.unconsumed_tail
    while begun and (out := inflate.decompress(inflate.unconsumed_tail, BLOCK)):
        yield out
    if begun and not inflate.eof:
        raise ValueError("the archive ends within a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, each whole."""
    have = bytearray()
    need = -1
    for block in blocks:
        have += block
        while True:
            if need < 0:
                end = have.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x[16:]) for x in bytes(have[:end]).split(b"\r\n") if x[:16].lower() == b"content-length: ")
                need = end + 4 + length + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = -1
    if have:
        raise ValueError("the archive ends within a record")


def _write_monolithic(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = None
    size = n = 0

    def closed() -> pa.RecordBatch:
        stream, deflate, name = out
        stream.write(deflate.flush())
        stream.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n"])

    for batch in batches:
        for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, path = _filesystem(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out, size = (system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), name), 0
                n = 0
            data = record(page_id, url, html, refers_to, revisit)
            size += len(data)
            n += 1
            out[0].write(out[1].compress(data))
            if size >= ARCHIVE_BYTES:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def normalise_file(source: str, target: str) -> int:
    """Rewrites an archive as one member for each record, with its sidecar ``<target>.idx``; returns the number of records."""
    system, path = _filesystem(source)
    to_system, to_path = _filesystem(target)
    at = n = 0
    with system.open_input_stream(path, compression=None) as stream, to_system.open_output_stream(to_path, compression=None) as out, to_system.open_output_stream(f"{to_path}.idx") as index:
        for data in records(inflated(stream)):
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = deflate.compress(data) + deflate.flush()
            out.write(member)
            index.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
            at += len(member)
            n += 1
    return n


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            target = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex}-members.warc.gz"
            n = normalise_file(source, target)
            if expected is not None and n != expected:
                raise ValueError(f"{source} has {n} records; {expected} were written")
            yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([target]), pa.array([n], pa.int64())], ["source", "path", "n"])


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_member(file: pa.NativeFile, offset: int, length: int) -> dict:
    return parse_record(zlib.decompress(file.read_at(length, offset), 31))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            system, path = _filesystem(name)
            with system.open_input_stream(f"{path}.idx") as sidecar:
                index = [json.loads(x) for x in sidecar.read().splitlines()]
            with system.open_input_file(path) as file:
                for at in range(0, len(index), 1000):
                    rows = [read_member(file, x["offset"], x["length"]) for x in index[at : at + 1000]]
                    yield pa.RecordBatch.from_pylist(rows, _ROW)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes monolithic archives below ``folder``; (path, n) of each, ``n`` being its records.

    Of records whose payloads are equal and have at least ``least_bytes`` bytes
    that with the largest page_id is a response and the others revisit it.
    Null html is an empty payload. Rows repeated under the largest id are
    responses all. Null ids revisit a record that has one; where none has, they
    are responses all.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    marked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    marked = written(marked.where(F.col("n") >= least_bytes).select("page_id", F.unhex("digest").alias("digest")), "payload-digests")
    groups = marked.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1")
    revisits = written(groups.where("refers_to is not null").select("digest", "refers_to"), "revisited")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.unhex(F.sha1(payload)).alias("own_digest"), (F.length(payload) >= least_bytes).alias("counts"))
    few = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    joined = rows.join(few, F.col("counts") & (F.col("own_digest") == F.col("digest")), "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    made = joined.select("page_id", "url", "html", "refers_to", revisit.alias("revisit")).mapInArrow(lambda b: _write_monolithic(b, folder), "path string, n long")
    return written(made, "archives")


def _one_each(archives: DataFrame, columns: list[str]) -> DataFrame:
    """``archives`` dealt out singly: rows of a few bytes stand for large files, so Spark's own sizes would put many into one task."""
    return archives.select(*columns).repartition(max(1, min(MOST_TASKS, archives.count())))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(source, path, n): each archive of ``archives`` (path, n) rewritten with a member for each record.

    The job fails on an archive that is cut short or has other bytes between or
    after its members, and on one that hasn't the ``n`` records it should have
    (null: unknown).
    """
    ship(archives.sparkSession)
    known = archives if "n" in archives.columns else archives.withColumn("n", F.lit(None).cast("long"))
    return written(_one_each(known, ["path", "n"]).mapInArrow(_normalise, "source string, path string, n long"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives (path), by their sidecars."""
    ship(archives.sparkSession)
    return _one_each(archives, ["path"]).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages written to archives, normalised, and read back: one row for each page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). Nulls and
    repeated rows as :func:`write_archives` says. A very long payload is held
    whole by its task, once. An empty table gives an empty one. Other columns
    aren't read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives = write_archives(pages, folder, id_col, url_col, html_col)
    made = normalise_archives(archives)
    back = written(read_archives(made), "warc-records")
    delete_path(spark, folder)
    return back


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``pages`` table through archives and back."""
    return round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
),
b AS (SELECT *, CAST(CAST(from_hex(hex) AS BIT) AS VARCHAR) AS bits FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM b)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
           + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
           + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM g
"""
