"""WARC archives as tables of chunks.

A record's bytes (WARC headers, HTTP headers, payload, two line ends) are rows of record_id and chunk number, no row
with more than `CHUNK` bytes of payload. Chunks of an archive in order of (record_id, chunk) are a WARC 1.1 file. Each
row carries the SHA-1 of the payload up to its end, so that readers verify a record as it streams by and hold one chunk
at a time. Writers cut a payload where it lies and hand on chunks as they are cut, `HELD` bytes of them at a time. Tables
are stored by Spark's writers, in any store that Spark reads.

A response is named by its key and digest, so that a revisit names the response it refers to before either is written.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import cut, in_small_batches

CHUNK = 1 << 16
#: Bytes of chunks that a writer hands on at once.
HELD = 1 << 22
#: Payloads of fewer bytes are never written as revisits.
LEAST_SHARED = 0
_ROW = "archive int, record_id string, chunk int, chunks int, bytes binary, digest string"
_TIME = "%Y-%m-%dT%H:%M:%SZ"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOUND = [("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _named(page: int | None, digest: str) -> str:
    """The name of the response of a page."""
    return f"urn:page:{'' if page is None else page}:{digest}"


def _head(name: str, kind: str, date: str, uri: str | None, digest: str, length: int, refers_to: str | None) -> bytes:
    """Headers of a record, up to where its payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (length if kind == "response" else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def chunks(record: str, name: str, kind: str, date: str, uri: str | None, digest: str, payload: memoryview, refers_to: str | None, chunk_bytes: int) -> Iterator[tuple]:
    """record_id, chunk, chunks, bytes and digest so far of each chunk of a record, one at a time."""
    body = payload if kind == "response" else payload[:0]
    count, sha = max(1, -(-len(body) // chunk_bytes)), hashlib.sha1()
    for i in range(count):
        piece = body[i * chunk_bytes : (i + 1) * chunk_bytes]
        sha.update(piece)
        head = _head(name, kind, date, uri, digest, len(payload), refers_to) if i == 0 else b""
        yield record, i, count, b"".join([head, piece, b"\r\n\r\n" if i == count - 1 else b""]), sha.hexdigest()


def _written(chunk_bytes: int):
    kinds = {"archive": pa.int32(), "record_id": pa.string(), "chunk": pa.int32(), "chunks": pa.int32(), "bytes": pa.binary(), "digest": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, n, held, size = context.partitionId() if context else 0, 0, [], 0

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*held), kinds.values())], names=list(kinds))

        for batch, texts in tx.blocks(batches, "html"):
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            for page, uri, sha, refers, date, payload in zip(col("page_id"), col("url"), col("digest"), col("refers_to"), col("date"), texts):
                digest, kind = _base32(bytes.fromhex(sha)), "response" if refers is None else "revisit"
                record = f"{'' if page is None else page}:{part}:{n}"
                # nothing refers to revisits, nor to pages without a key
                name = _named(page, digest) if refers is None and page is not None else f"{_named(page, digest)}:{part}:{n}"
                n += 1
                for chunk in chunks(record, name, kind, date, uri, digest, payload, None if refers is None else _named(refers, digest), chunk_bytes):
                    held.append((part, *chunk))
                    size += len(chunk[3])
                    if size >= HELD:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return rows


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_shared: int = LEAST_SHARED, chunk_bytes: int = CHUNK, date: str | None = None) -> DataFrame:
    """The chunk table of an archive for each task: a record for each row of pages. `date` is a column of times of
    capture; without it, or where it is null, records have the time at which they are written.

    Of rows with equal payloads of at least `least_shared` bytes those with the largest key are responses, the others
    revisit it; shorter payloads are all responses. Null payloads are empty; a null key is below all others and, where
    no other row has the payload, a response. Rows of equal key and payload are records of their own, as responses
    under one WARC-Record-ID. Payloads of any length are written whole. Other columns, whatever their names, are not
    written. An empty table gives an empty one.
    """
    now, body = datetime.now(UTC).strftime(_TIME), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    when = F.lit(now) if date is None else F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(now))
    plain = in_small_batches(pages).select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("html"), F.sha1(body).alias("digest"), F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)).alias("length"), when.alias("date"))
    # only digests of several rows matter: a table of a size that Spark knows before it picks the join
    shared = cut(plain.where(F.col("length") >= least_shared).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("shared"), "newest"))
    known = plain.join(shared, (F.col("digest") == F.col("shared")) & (F.col("length") >= least_shared), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    return known.select("page_id", "url", "html", "digest", "date", refers.alias("refers_to")).mapInArrow(_written(chunk_bytes), _ROW)


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "surrogateescape").split("\r\n")[1:])}


class Reader:
    """A record that streams by, chunk by chunk."""

    def __init__(self, first: bytes) -> None:
        head, gap, rest = first.partition(b"\r\n\r\n")
        http, gap2, rest = rest.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1.") or not gap or not gap2:
            raise ValueError("not a WARC record of an HTTP response")
        self.fields, self.http, self.sha, self.left = _fields(head), _fields(http), hashlib.sha1(), None
        self.body = int(self.fields["content-length"]) - len(http) - 4
        self.left = self.body
        self.tail = b""
        self.feed(rest)

    def feed(self, piece: bytes) -> None:
        own = piece[: self.left]
        self.sha.update(own)
        self.left -= len(own)
        self.tail += piece[len(own) :]

    def done(self) -> tuple:
        """What the record says, once its length and digest are found true."""
        kind, digest, length = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:"), int(self.http["content-length"])
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError(f"{self.fields['warc-record-id']}: cut short or too long")
        if kind == "response" and (length != self.body or _base32(self.sha.digest()) != digest):
            raise ValueError(f"{self.fields['warc-record-id']}: its payload isn't what its headers say")
        page, refers = (self.fields.get(f, "").removeprefix("<urn:page:").split(":")[0] for f in ("warc-record-id", "warc-refers-to"))
        return int(page) if page else None, self.fields.get("warc-target-uri"), kind, length, digest, int(refers) if refers else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, reader = None, None
    for batch in batches:
        found = []
        data = batch.column(batch.schema.get_field_index("bytes"))
        ids, numbers, counts, digests = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record_id", "chunk", "chunks", "digest"))
        for i, record in enumerate(ids):
            piece = data[i].as_buffer().to_pybytes()
            if numbers[i] == 0:
                reader, now, following = Reader(piece), record, 0
            elif record != now or numbers[i] != following:
                raise ValueError(f"{record}: chunk {numbers[i]} is out of place")
            else:
                reader.feed(piece)
            following = numbers[i] + 1
            if reader.sha.hexdigest() != digests[i]:
                raise ValueError(f"{record}: chunk {numbers[i]} was changed")
            if following == counts[i]:
                found.append(reader.done())
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, (_, t) in zip(zip(*found) if found else [[]] * len(_FOUND), _FOUND)], names=[n for n, _ in _FOUND])


def read(table: DataFrame) -> DataFrame:
    """A row for each record of a chunk table: page_id, uri, record_type, payload_bytes and payload_digest (of the full
    payload, also where a record only refers to it) and refers_to. Records whose bytes aren't what they say raise.
    Records of any length are read a chunk at a time; an empty table gives an empty one."""
    schema = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    table = in_small_batches(table)
    whole = table.where("chunks = 1").mapInArrow(_read, schema)
    long_ = table.where("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(_read, schema)
    return whole.union(long_)


def export(table: DataFrame, archive: int, out: BinaryIO) -> None:
    """Writes one archive of a chunk table as a WARC file, chunk by chunk."""
    for row in table.where(F.col("archive") == archive).orderBy("record_id", "chunk").select("bytes").toLocalIterator():
        out.write(row["bytes"])
