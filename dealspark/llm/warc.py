"""WARC archives: written as one gzip stream, normalised to a member per record with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, new_path, release, stored

LEVEL, CHUNK, MAX_BROADCAST_ROWS = 4, 1 << 20, 200_000
DATE = "2000-01-01T00:00:00Z"


def file_system(uri: str):
    """Also for stores other than a mounted disk; every executor opens the same URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def urn(page_id) -> str:
    """The id, escaped so that no character ends the field; a null id is a name without one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, digest: bytes, first) -> bytes:
    """A response holds the payload; a revisit its HTTP head only, and the page it refers to."""
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if first is None else 'revisit'}\r\nWARC-Record-ID: {urn(page_id)}\r\nWARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if first is not None:
        head.append(f"WARC-Refers-To: {urn(first)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a gzip file of one or more members, inflated once as a stream by CHUNK bytes at most; only one record
    is held at a time."""
    inflate, buffer, need = zlib.decompressobj(31), bytearray(), None

    def inflated() -> Iterator[bytes]:
        nonlocal inflate
        for chunk in chunks:
            while chunk:
                yield inflate.decompress(chunk, CHUNK)
                chunk = inflate.unconsumed_tail
                if inflate.eof:
                    chunk, inflate = inflate.unused_data, zlib.decompressobj(31)

    for part in inflated():
        buffer += part
        at = 0
        while True:
            if need is None and (end := buffer.find(b"\r\n\r\n", at)) >= 0:
                need = end + 4 - at + int(fields(bytes(buffer[at:end]))["content-length"]) + 4
            if need is None or len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at += need
            need = None
        del buffer[:at]
    if buffer:
        raise ValueError("the archive ends inside a record")


def revisits(pages: DataFrame) -> DataFrame:
    """(_id, _digest, _first): pages whose payload an earlier page (by page_id, null last) has; one row per id and payload.

    Only ids and digests are shuffled; copies of one payload meet in an aggregate, which is written, so that both sides of
    the join are plain exchanges and a hot digest's partition is split.
    """
    narrow = stored(pages.select(F.col("page_id").alias("_id"), digest_of().alias("_digest")), "digests")
    first = stored(narrow.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("_digest", "_d"), "first-pages")
    out = stored(later(narrow, first).distinct(), "revisits")
    release(narrow, first)
    return out


def later(narrow: DataFrame, first: DataFrame) -> DataFrame:
    """Rows (_id, _digest) that are not the first of their digest, with it."""
    met = narrow.join(first.hint("merge"), F.col("_digest") == F.col("_d")).where("_first IS NOT NULL AND NOT _id <=> _first")
    return met.select("_id", "_digest", "_first")


def digest_of():
    return F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(path, n): each partition's records as one gzip stream. A retried task writes a new file; the table returned, which
    is written after the tasks' success, alone says which files count."""
    late = revisits(pages)
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest_of().alias("digest"))
    small = late.count() <= MAX_BROADCAST_ROWS
    df = df.join(F.broadcast(late) if small else late.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "_first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, gz = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    store, at = file_system(path)
                    store.create_dir(posixpath.dirname(at), recursive=True)
                    out = store.open_output_stream(at, compression=None)
                page_id, url, html, digest, first = (x.as_py() for x in row)
                out.write(gz.compress(record(page_id, url, html.encode(), digest, first)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    out = stored(map_texts(df, run, "path string, n long"), "monolithic")
    release(late)
    return out


def spread(manifest: DataFrame) -> DataFrame:
    """A task for each archive, as far as a few thousand go."""
    return manifest.repartition(max(1, min(manifest.count(), 4096)))


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """(path, index, n): every archive rewritten with each record as its own gzip member, and beside it an index: a line of
    JSON (offset, length, record id) for each record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                (store, at), (own, here) = file_system(path), file_system(source)
                store.create_dir(posixpath.dirname(at), recursive=True)
                offset = n = 0
                with own.open_input_stream(here, compression=None) as stream, store.open_output_stream(at, compression=None) as out, store.open_output_stream(at + ".idx") as index:
                    for rec in records(iter(lambda s=stream: s.read(CHUNK), b"")):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(rec) + gz.flush()
                        out.write(member)
                        name = fields(rec[: rec.index(b"\r\n\r\n")])["warc-record-id"]
                        index.write(json.dumps([offset, len(member), name]).encode() + b"\n")
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [path], "index": [path + ".idx"], "n": pa.array([n], pa.int64())})

    return stored(spread(manifest.select("path")).mapInArrow(run, "path string, index string, n long"), "normalised")


def page_of(field: str | None) -> str | None:
    return unquote(field[len("<urn:page:") : -1]) if field and field.startswith("<urn:page:") else None


def read_archives(manifest: DataFrame, id_type: str = "long", batch_rows: int = 512) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each got by its index entry.

    A response's length and digest are those of the payload read; a revisit's are what its HTTP and WARC heads say.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = file_system(path)
                with store.open_input_stream(store_path(index)) as f:
                    entries = [json.loads(x) for x in f.readall().splitlines()]
                with store.open_input_file(at) as f:
                    for start in range(0, len(entries), batch_rows):
                        yield rows(f, entries[start : start + batch_rows])

    def store_path(uri: str) -> str:
        return file_system(uri)[1]

    def rows(f, entries) -> pa.RecordBatch:
        out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        for offset, length, _ in entries:
            f.seek(offset)
            rec = zlib.decompress(f.read(length), 31)
            head, _, block = rec.partition(b"\r\n\r\n")
            warc = fields(head)
            http, _, payload = block[: int(warc["content-length"])].partition(b"\r\n\r\n")
            late = warc["warc-type"] == "revisit"
            out["page_id"].append(page_of(warc["warc-record-id"]))
            out["payload_bytes"].append(int(fields(http)["content-length"]) if late else len(payload))
            out["payload_digest"].append(warc["warc-payload-digest"].removeprefix("sha1:") if late else base64.b32encode(hashlib.sha1(payload).digest()).decode())
            out["record_type"].append(warc["warc-type"])
            out["refers_to"].append(page_of(warc.get("warc-refers-to")))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "payload_bytes" else pa.string()) for k, v in out.items()], list(out))

    df = spread(manifest.select("path", "index")).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return df.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to archives, normalise them and read every record back.

    Null html is an empty payload, null urls have no target field. Of equal payloads that of the least page_id is the
    response (rows that repeat this id too); null ids come last, and among null ids only all are responses. Empty input:
    no archive, no rows. Extra columns are not read.
    """
    base = folder or new_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(normalise(write_monolithic(pages, f"{base}/monolithic"), f"{base}/normalised"), kind)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first, sha1(html) AS hex FROM p GROUP BY html),
g AS (SELECT html, first, [('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5))::INTEGER FOR k IN range(8)] AS v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc FROM f)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
  array_to_string([abc[(x >> 15) % 32 + 1] || abc[(x >> 10) % 32 + 1] || abc[(x >> 5) % 32 + 1] || abc[x % 32 + 1] FOR x IN v], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g ON p.html = g.html
"""
