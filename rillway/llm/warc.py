"""WARC archives as a table of chunks: written and read back without a whole record in memory."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.word_arrays import text_bytes
from rillway.session import scratch_path
from rillway.sources.fields import named

CHUNK = 1 << 20
# A task begins a new archive after so many written bytes.
ARCHIVE_BYTES = 256 << 20
# Rows are passed on in batches of about so many bytes.
BATCH_BYTES = 4 << 20
# Fixed by the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = "record long, url string, refers_to long, chunk int, start long, data binary, digest binary, payload_digest binary, total long, last boolean"
_CHUNK_ARROW = pa.schema(
    [("record", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()),
     ("data", pa.binary()), ("digest", pa.binary()), ("payload_digest", pa.binary()), ("total", pa.int64()), ("last", pa.bool_())]
)


@F.arrow_udf(T.StringType())
def base32(digest: pa.Array) -> pa.Array:
    return pa.array([None if d is None else base64.b32encode(d).decode() for d in digest.to_pylist()], pa.string())


def _batches(rows: Iterator[tuple], schema: pa.Schema, data_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data_at] or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _chunked(with_data: bool, chunk_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            keys, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i in range(batch.num_rows):
                payload = memoryview(data[offsets[i] : offsets[i + 1]])
                total, state = len(payload), hashlib.sha1()
                whole = hashlib.sha1(payload).digest()
                for n, start in enumerate(range(0, total or 1, chunk_bytes)):
                    part = payload[start : start + chunk_bytes]
                    state.update(part)
                    last = start + chunk_bytes >= total
                    if with_data or last:
                        yield keys[i], urls[i], refers[i], n, start, bytes(part) if with_data else None, state.digest(), whole, total, last

    return lambda batches: _batches(rows(batches), _CHUNK_ARROW, 5)


def payload_chunks(pages: DataFrame, *, with_data: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of (record, url, payload, refers_to) rows.

    One row per chunk of at most ``chunk_bytes`` bytes: its number and place, the SHA-1 of the
    payload up to its end, and the SHA-1 and size of the whole payload. An empty or null payload is
    one empty chunk. ``with_data=False`` gives only the last chunk of each, without bytes.
    """
    return pages.select("record", "url", "payload", "refers_to").mapInArrow(_chunked(with_data, chunk_bytes), CHUNK_SCHEMA)


def record_uri(record: int | None) -> str:
    return f"<urn:page:{'' if record is None else record}>"


def record_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _head(record, url, refers_to, digest: bytes, total: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(record)}", f"WARC-Date: {date}"]
    if url is not None:
        # A line break in a header would end it.
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http;msgtype=response"]
    lines.append(f"Content-Length: {len(http) + (total if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _archive_writer(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write chunk rows, each record's in order, as gzip members; one row per archive."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, stamp = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, packer, name, written, records, number = None, None, "", 0, 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                record, url, refers_to, chunk, _, data, _, digest, total, last = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"part-{part:05d}-{stamp}-{number:04d}.warc.gz"
                    out, written, records, number = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, number + 1
                pieces = []
                if chunk == 0:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    pieces.append(packer.compress(_head(record, url, refers_to, digest, total, date)))
                if refers_to is None:
                    pieces.append(packer.compress(data))
                if last:
                    pieces += [packer.compress(b"\r\n\r\n"), packer.flush()]
                    records += 1
                for piece in pieces:
                    out.write(piece)
                    written += len(piece)
                if last and written >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.record_batch([[f"{folder}/{name}"], [records], [written]], ["path", "records", "bytes"])
        if out is not None:
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"], [records], [written]], ["path", "records", "bytes"])

    return run


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row as .warc.gz below ``folder``; (path, records, bytes) of each archive.

    Of payloads of ``min_revisit_bytes`` or more that are equal, the row with the largest id is a
    response and the others revisit it; all others are responses. Digests come from a first scan of
    chunks; revisits are found on (id, digest, size) rows alone: the largest id per digest is an
    aggregate, joined back to the digests, so a payload of a third of all pages is no hot task. Pages
    are scanned a second time and written where they are read; they are shuffled only if the
    revisits outgrow Spark's own limit for a broadcast.

    ``folder`` must be one that all executors reach. A repeated task writes files of new names, and
    the result lists those of the tasks that ended well, so use what is listed and nothing else.

    Null payloads are empty ones. Null urls have no header. A null id is written as such, and is a
    response only if no equal payload has an id. Rows that repeat an id are written each. An empty
    table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(named(id_col).cast("long").alias("record"), named(url_col).cast("string").alias("url"), named(payload_col).cast("string").alias("payload"))
    no_reference = F.lit(None).cast("long").alias("refers_to")
    path = scratch_path(spark, "digests")
    payload_chunks(rows.select("*", no_reference), with_data=False).select("record", "digest", "total").write.parquet(path)
    digests = spark.read.parquet(path).filter(F.col("total") >= min_revisit_bytes)
    newest = digests.groupBy("digest", "total").agg(F.max("record").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    path = scratch_path(spark, "revisits")
    again = digests.join(newest, ["digest", "total"]).filter("NOT (record <=> refers_to) AND refers_to IS NOT NULL")
    again.select("record", "digest", "refers_to").distinct().write.parquet(path)
    revisits = spark.read.parquet(path).select(F.col("record").alias("r"), F.col("digest").alias("d"), "refers_to")
    if revisits.isEmpty():
        marked = rows.select("*", no_reference)
    else:
        # The digest tells rows of one id apart.
        sha1 = F.unhex(F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
        same = F.col("record").eqNullSafe(F.col("r")) & (sha1 == F.col("d"))
        marked = rows.join(revisits, same, "left").select("record", "url", "payload", "refers_to")
    chunks = payload_chunks(marked, chunk_bytes=chunk_bytes)
    path = scratch_path(spark, "archives")
    chunks.mapInArrow(_archive_writer(folder.rstrip("/"), date, archive_bytes), "path string, records long, bytes long").write.parquet(path)
    return spark.read.parquet(path)


class _Records:
    """Lines and bytes of the gzip members of a stream, unpacked as they are asked for."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.at, self.unpack = stream, b"", b"", 0, zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.stream.read(1 << 18)
                if not self.packed:
                    return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.packed, 1 << 20)
            self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.plain, self.at = self.plain[self.at :] + got, 0
                return True

    def line(self) -> bytes | None:
        while (end := self.plain.find(b"\r\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.plain):
                    raise ValueError("the archive ends within a line")
                return None
        out, self.at = self.plain[self.at : end], end + 2
        return out

    def read(self, n: int) -> bytes:
        """Between 1 and n bytes."""
        if self.at == len(self.plain) and not self._more():
            raise ValueError("the archive ends within a record")
        out = self.plain[self.at : self.at + n]
        self.at += len(out)
        return out


READ_SCHEMA = (
    "record_id string, record_type string, url string, refers_to string, chunk int, start long, data binary,"
    " digest binary, header_digest string, last boolean"
)
_READ_ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int32()),
     ("start", pa.int64()), ("data", pa.binary()), ("digest", pa.binary()), ("header_digest", pa.string()), ("last", pa.bool_())]
)


def _archive_reader(with_data: bool, chunk_bytes: int):
    def fields(source: _Records) -> tuple[dict[str, str], int]:
        out, size = {}, 0
        while line := source.line():
            size += len(line) + 2
            name, _, value = line.decode().partition(":")
            out[name.lower()] = value.strip()
        return out, size + 2

    def records(path: str) -> Iterator[tuple]:
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(path)
        with files.open_input_stream(place, compression=None) as stream:
            source = _Records(stream)
            while (version := source.line()) is not None:
                if not version.startswith(b"WARC/"):
                    raise ValueError(f"no record begins where one should, in {path}")
                warc, _ = fields(source)
                left = int(warc["content-length"])
                status = source.line()
                _, size = fields(source)
                left -= len(status) + 2 + size
                facts = (warc["warc-record-id"], warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-refers-to"))
                known = warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
                state, start, number = hashlib.sha1(), 0, 0
                while number == 0 or left:
                    parts, size = [], 0
                    while left and size < chunk_bytes:
                        part = source.read(min(left, chunk_bytes - size))
                        state.update(part)
                        size, left = size + len(part), left - len(part)
                        if with_data:
                            parts.append(part)
                    if with_data or not left:
                        yield *facts, number, start, b"".join(parts) if with_data else None, state.digest(), known, not left
                    start, number = start + size, number + 1
                if source.line() or source.line():
                    raise ValueError(f"a record of another length than stated, in {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(records(path), _READ_ARROW, 6)

    return run


def read_archives(archives: DataFrame, *, with_data: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that the rows of ``archives`` (path) name.

    One row per chunk, with the SHA-1 of the payload up to its end; the payload is what follows the
    HTTP header. A record without payload, as revisits are, is one empty chunk. Archives are spread
    over tasks; each is unpacked as a stream, of which a task holds one chunk. ``with_data=False``
    reads everything, and gives only the last chunk of each record, without bytes; its ``start`` is
    then where that chunk begins. An archive cut short or with records of a wrong length is an
    error. No archives give no rows.
    """
    paths = archives.select("path")
    spread = paths.repartition(max(1, min(paths.count(), 10_000)), "path")
    return spread.mapInArrow(_archive_reader(with_data, chunk_bytes), READ_SCHEMA)


def read_records(archives: DataFrame) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, payload_digest, intact) of each record.

    Size and digest are those of the full payload: a revisit takes them from the response that it
    refers to. ``intact`` says that the digest read equals the one stated.
    """
    size = F.length("data").cast("long") + F.col("start")
    last = read_archives(archives).filter("last").select("record_id", "url", "record_type", "refers_to", size.alias("size"), base32("digest").alias("read"), "header_digest")
    path = scratch_path(archives.sparkSession, "records")
    last.write.parquet(path)
    rows = archives.sparkSession.read.parquet(path)
    responses = rows.filter("record_type = 'response'").select(F.col("record_id").alias("r_id"), F.col("size").alias("r_size"), F.col("read").alias("r_read")).dropDuplicates(["r_id", "r_read"])
    referring = rows.filter("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("r_id")) & (F.col("header_digest") == F.col("r_read")), "left")
    names = ("record_id", "url", "record_type", "refers_to")
    told = referring.select(*names, F.col("r_size").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), F.col("r_read").isNotNull().alias("intact"))
    own = rows.filter("record_type <> 'revisit'").select(*names, F.col("size").alias("payload_bytes"), F.col("read").alias("payload_digest"), F.col("read").eqNullSafe(F.col("header_digest")).alias("intact"))
    return own.unionByName(told)
