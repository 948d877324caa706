"""WARC 1.1 archives: one gzip member per record, written by tasks and read back as streams.

Archives lie in a folder that all executors reach (the shared checkpoint folder unless a caller
names another). Each attempt of a task writes files of its own name, and only the files that the
written manifest lists count, so lost executors and repeated tasks leave no doubled records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_dir, small_batches

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_CHUNK = 1 << 18
_MOST_HEADER = 64 << 20  # of writer and reader


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """The bytes of a response record, or of a revisit record if it refers to another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(payload), _END)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(uri or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    head = "\r\n".join(lines).encode()
    if len(head) > _MOST_HEADER:
        raise ValueError("a header is longer than readers take")
    return head + _END + block + _END


def _one_line(uri: str) -> str:
    """The URI with white space and control characters percent-encoded."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m[0]), uri)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Member:
    """One gzip member, decompressed only as far as it is asked for."""

    def __init__(self, source: BinaryIO, rest: bytes):
        self.source, self.compressed, self.plain, self.z = source, rest, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        """Whether some plain bytes were added."""
        while not self.z.eof:
            if not self.compressed:
                self.compressed = self.source.read(_CHUNK)
                if not self.compressed:
                    raise EOFError("the archive ends inside a gzip member")
            got = self.z.decompress(self.compressed, _CHUNK)
            self.compressed = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.plain += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark))
            if len(self.plain) > _MOST_HEADER + _CHUNK or not self.more():
                raise ValueError("a header has no end")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def blocks(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.plain and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            part = bytes(self.plain[:size])
            del self.plain[: len(part)]
            size -= len(part)
            yield part


def read_records(source: BinaryIO, with_payload: bool = True) -> Iterator[dict[str, Any]]:
    """Records of an archive in order.

    Each is framed by its Content-Length; block and payload digests are computed from what was
    read and compared with the declared ones (digest_ok; None where none is declared). Damage
    (no header, a short block, bytes after a record, a cut member) raises ValueError or EOFError.
    """
    rest = source.read(_CHUNK)
    while rest:
        member = _Member(source, rest)
        head = member.until(_END)
        if not head.startswith(b"WARC/"):
            raise ValueError("a record does not start with WARC/")
        named = _headers(head)
        size, block, payload = int(named["content-length"]), hashlib.sha1(), hashlib.sha1()
        http, body, length, kept = bytearray(), None, 0, bytearray()
        is_http = named.get("content-type", "").startswith("application/http")
        for part in member.blocks(size):
            block.update(part)
            if is_http and body is None:
                http += part
                if (at := http.find(_END)) < 0:
                    continue
                part, body = bytes(http[at + 4 :]), True
                del http[at:]
            payload.update(part)
            length += len(part)
            if with_payload:
                kept += part
        tail = b""
        while len(tail) < 4 or not member.z.eof:
            tail += bytes(member.plain)
            member.plain.clear()
            if len(tail) > 4 or not member.more():
                break
        if tail + bytes(member.plain) != _END:
            raise ValueError("a record does not end after its block")
        rest = member.compressed or source.read(_CHUNK)
        digests = {k: base64.b32encode(h.digest()).decode() for k, h in (("block", block), ("payload", payload))}
        revisit = named.get("warc-type") == "revisit"
        declared = {k: v.partition(":")[2] for k in digests if (v := named.get(f"warc-{k}-digest", "")).startswith("sha1:")}
        checks = [digests[k] == v for k, v in declared.items() if not (revisit and k == "payload")]
        full = _headers(bytes(http)).get("content-length") if revisit else None
        yield {
            "record_type": named.get("warc-type"),
            "record_id": named.get("warc-record-id", "").strip("<>"),
            "target_uri": named.get("warc-target-uri"),
            "refers_to": named.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": declared.get("payload") if revisit else digests["payload"],
            "payload_bytes": int(full) if full is not None else length,
            "digest_ok": all(checks) if checks else None,
            "payload": bytes(kept) if with_payload and not revisit else None,
        }


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes a record per row of pages under folder; returns the manifest (path, records, bytes).

    Of rows with equal payloads (UTF-8; null: empty) of at least min_revisit_bytes, the one with
    the least id is a response and the others revisit it; smaller payloads are all responses.
    Rows that repeat that least id with its payload are responses too; a row with a null id
    is a revisit where its payload has a row with an id, else a response. An empty table
    gives no archive. Other columns, whatever their names, are not read.

    Bodies move once, by id and digest, to meet the decision; a digest with very many copies
    is decided by a minimum and spread again by the id.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    marks = rows.select("id", "digest", (F.length("body") >= min_revisit_bytes).alias("counts")).where("counts")
    firsts = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # A key of the pair (id, digest): one row each, so that repeated rows don't multiply.
    revisits = marks.select("id", "digest").distinct().join(firsts, "digest").where("id is null or id <> first")
    revisits = revisits.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers"))
    told = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("id", "uri", "body", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        task = TaskContext.get()
        stem = f"{root}/part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            ids, uris, bodies, refers = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, count, size = store.open_output_stream(name, compression=None), 0, 0
                to = refers[i].as_py()
                plain = record(_urn(ids[i].as_py()), uris[i].as_py(), bodies[i].as_py(), None if to is None else _urn(to))
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(plain) + z.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_pylist([{"path": p, "records": n, "bytes": b} for p, n, b in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    _folder(folder)
    return cut(small_batches(told).mapInArrow(run, "path string, records long, bytes long"))


def _folder(folder: str) -> None:
    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)


def _urn(record_id: Any) -> str:
    return f"urn:x-record:{'' if record_id is None else quote(str(record_id), safe='')}"


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives whose paths a manifest lists; tasks stream them one by one.

    folder gives the store of the paths. Columns: record_id, target_uri, record_type, refers_to,
    payload_bytes, payload_digest, digest_ok, payload (null for revisits).
    """
    fields = [("record_id", "string"), ("target_uri", "string"), ("record_type", "string"), ("refers_to", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("digest_ok", "boolean"), ("payload", "binary")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[v]) for k, v in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    held, size = [], 0
                    for found in read_records(source, with_payload):
                        held.append(found)
                        size += len(found["payload"] or b"")
                        if len(held) >= 2000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.select("path").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields))


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
