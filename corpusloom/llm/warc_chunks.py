"""WARC archives from a table of pages, and back, as chunk rows with running digests."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import staged

CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 8 << 20  # compressed bytes that one task reads back, about
DATE = "2000-01-01T00:00:00Z"
HEADER_BYTES = 1 << 20  # a header line may be no longer

# Names and forms of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk_no long, last boolean, data binary, running_bytes long, running_digest string"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to``: who holds a payload, who revisits.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest id is the
    response; rows that repeat that id are responses, too, and null ids count as smallest.
    Only payloads that occur more than once are joined back.
    """
    digest = F.sha1("payload")
    seen = pages.withColumn("digest", digest)
    repeated = seen.where(F.length("payload") >= least_bytes).groupBy("digest")
    heads = repeated.agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Staged, so that pages are a plain side of the join: Spark can split a hot payload.
    joined = seen.join(staged(heads, "heads"), "digest", "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")) & (F.length("payload") >= least_bytes)
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: each payload as rows of at most ``chunk_bytes``, in order.

    Every row has the count and SHA-1 of all bytes up to its end, so the last one has those of
    the payload.  A revisit is one row without data; an empty payload one row of no bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head = [batch.column(c).slice(i, 1) for c in ("page_id", "url", "record_type", "refers_to")]
                payload = memoryview(batch.column("payload")[i].as_buffer())
                full = base32(bytes.fromhex(batch.column("digest")[i].as_py()))
                whole = batch.column("record_type")[i].as_py() == "response"
                running, ends = hashlib.sha1(), range(chunk_bytes, max(len(payload), 1) + chunk_bytes, chunk_bytes)
                for number, end in enumerate(ends if whole else ends[:1]):
                    data = payload[end - chunk_bytes : end] if whole else b""
                    running.update(data)
                    passed = min(end, len(payload)) if whole else 0
                    row = [len(payload), full, number, not whole or end >= len(payload), bytes(data), passed]
                    row.append(base32(running.digest()))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
                    columns = [*head, *(pa.array([v], kind) for v, kind in zip(row, kinds))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    kept = records.select("page_id", "url", "record_type", "refers_to", "payload", "digest")
    return kept.mapInArrow(cut, CHUNK_SCHEMA)


def _line(name: str, value: object) -> str:
    """A header line; a missing value has none, and line breaks in a value are escaped."""
    if value is None:
        return ""
    return f"{name}: {re.sub('[\r\n\0]', lambda m: f'%{ord(m[0]):02X}', str(value)).strip()}\r\n"


def _record_id(page: object, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {kind}')}>"


def record_head(row: dict) -> bytes:
    """The record's header and its HTTP header.  The page's number has an extension field."""
    response = row["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    refers = None if response else _record_id(row["refers_to"], row["payload_digest"], "response")
    lines = [
        f"{VERSION}\r\n",
        _line("WARC-Type", row["record_type"]),
        _line("WARC-Record-ID", _record_id(row["page_id"], row["payload_digest"], row["record_type"])),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", row["url"]),
        _line("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        _line("WARC-Profile", None if response else REVISIT_PROFILE),
        _line("WARC-Refers-To", refers),
        _line("Page-Number", row["page_id"]),
        _line("Refers-To-Page-Number", row["refers_to"]),
        "Content-Type: application/http; msgtype=response\r\n",
        f"Content-Length: {len(http) + (row['payload_bytes'] if response else 0)}\r\n\r\n",
    ]
    return "".join(lines).encode() + http.encode()


def write_warc(chunks: DataFrame, path: str) -> DataFrame:
    """Write chunk rows, which must be whole and in order within partitions, as ``.warc.gz`` files.

    Each record is a gzip member of its own and is written as its chunks come.  Returns the
    staged list of segments (``file, start, length, records``): only files of tasks that
    finished are in it, so a lost or repeated task leaves nothing behind that is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        segments, start, at, records = [], 0, 0, 0
        member = running = None
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["chunk_no"] == 0:
                        member, running = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                        at += out.write(member.compress(record_head(row)))
                    running.update(row["data"])
                    at += out.write(member.compress(row["data"]))
                    if row["last"]:
                        if row["record_type"] == "response" and base32(running.digest()) != row["payload_digest"]:
                            raise ValueError(f"chunks of page {row['page_id']} are not its payload")
                        at += out.write(member.compress(b"\r\n\r\n") + member.flush())
                        records += 1
                        if at - start >= SEGMENT_BYTES:
                            segments.append((name, start, at - start, records))
                            start, records = at, 0
        if records:
            segments.append((name, start, at - start, records))
        if segments:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*segments), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "length", "records"])

    return staged(chunks.mapInArrow(write, "file string, start long, length long, records long"), "segments")


class Inflated:
    """Reads gzip members one after another with a bounded buffer."""

    def __init__(self, stream, length: int):
        self.stream, self.left = stream, length
        self.member, self.raw, self.buffer = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(min(1 << 16, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    return False
            found = self.member.decompress(self.raw, CHUNK_BYTES)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if found:
                self.buffer += found
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream."""
        seen = 0
        while (end := self.buffer.find(b"\r\n", max(seen - 1, 0))) < 0:
            seen = len(self.buffer)
            if seen > HEADER_BYTES:
                raise ValueError("a header line has no end")
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a line")
                return None
        found = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return found

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self._more():
                raise ValueError("the archive ends within a record")
        found = bytes(self.buffer[:size])
        del self.buffer[:size]
        return found

    def header(self) -> tuple[dict[str, str], int]:
        """Fields up to the blank line, by lower-case name, and their length in bytes."""
        fields, size = {}, 0
        while True:
            line = self.line()
            if line is None:
                raise ValueError("the archive ends within a header")
            size += len(line) + 2
            if not line:
                return fields, size
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()


def read_chunks(spark: SparkSession, path: str, segments: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table, streamed from the archives segment by segment.

    ``payload_bytes`` and ``payload_digest`` are what the headers say; running values come from
    the bytes read.  A response whose bytes do not give its digest is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        kinds += [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
        held, waiting = [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*held), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for segment in batch.to_pylist():
                with store.open_input_file(f"{folder}/{segment['file']}") as stream:
                    stream.seek(segment["start"])
                    source = Inflated(stream, segment["length"])
                    while (version := source.line()) is not None:
                        if version != VERSION.encode():
                            raise ValueError(f"no record begins with {version[:40]!r}")
                        fields, _ = source.header()
                        left = int(fields["content-length"])
                        left -= len(source.line()) + 2  # the status line
                        http, size = source.header()
                        left -= size
                        total, digest = int(http["content-length"]), fields["warc-payload-digest"].partition(":")[2]
                        page, refers = (fields.get(k) for k in ("page-number", "refers-to-page-number"))
                        head = (
                            None if page is None else int(page),
                            fields.get("warc-target-uri"),
                            fields["warc-type"],
                            None if refers is None else int(refers),
                            total,
                            digest,
                        )
                        running, passed, number = hashlib.sha1(), 0, 0
                        while True:
                            data = source.take(min(left, CHUNK_BYTES))
                            left -= len(data)
                            passed += len(data)
                            running.update(data)
                            seen = base32(running.digest())
                            if not left and head[2] == "response" and (seen, passed) != (digest, total):
                                raise ValueError(f"page {page}: its bytes do not give its digest")
                            held.append((*head, number, not left, data if with_data else None, passed, seen))
                            waiting += len(data) if with_data else 64
                            number += 1
                            if waiting >= 4 * CHUNK_BYTES or len(held) >= 8192:
                                yield block()
                                held, waiting = [], 0
                            if not left:
                                break
                        if source.take(4) != b"\r\n\r\n":
                            raise ValueError(f"page {page}: its record has no end")
        if held:
            yield block()

    tasks = segments.repartition(max(1, segments.count()), "file", "start")
    return tasks.mapInArrow(read, CHUNK_SCHEMA)


def archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write ``pages`` as archives under ``path``; returns their segments.

    A null payload is empty, a null id or address has no header field; other columns are not
    looked at; an empty table writes no records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    return write_warc(chunk_rows(record_types(rows, least_bytes)), path)
