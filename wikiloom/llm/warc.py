"""WARC archives (operator 13) by way of a chunked record table.

A payload is a run of rows (record, chunk, packed) of a bounded size, compressed, each with the length and the digests of
the payload so far; the last one has those of the whole. From this table on no step holds a whole record: duplicates are found by the
digests of last chunks, archives are written and read chunk by chunk.

``spark.read.format("warc")`` and ``df.write.format("warc")`` are a Python data source. Archives are gzip files with a
member for each record, of about a size each; the writer's tasks write under names of their own, and the commit moves the
files of those tasks that count, so that a task that is tried again leaves no record twice.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import shared_path, shared_table

#: Bytes of a chunk, and of an archive before the next one is begun.
CHUNK_BYTES, ARCHIVE_BYTES = 256 << 10, 1 << 30
#: Chunks that are sent to Spark at once.
SENT_BYTES = 4 << 20
#: Rows of one payload are joined with its first record in so many parts.
SALT = 32
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that pyarrow has for a path (local, hdfs, s3, gs, abfs) and the path in it."""
    where = re.sub(r"^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(where if ":" in where else f"file://{where}")


def record_chunks(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, size: int = CHUNK_BYTES) -> DataFrame:
    """(record, id, uri, chunk, packed, size, bytes, sha1, sha256, last): a row for each ``size`` bytes of each row's payload.

    packed holds ``size`` bytes, compressed; record numbers the rows of ``df``; bytes and the digests are those of the payload up to and with this chunk. A string
    is its UTF-8; a null or empty payload is one empty chunk; null ids and uris stay null. Repeated rows are records each;
    an empty table gives no rows; other columns aren't read.
    """
    bound_arrow_batches(df.sparkSession)
    payload = F.col(payload_col)
    raw = payload if isinstance(df.schema[payload_col].dataType, T.BinaryType) else F.encode(payload.cast("string"), "UTF-8")
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    numbered = df.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("string").alias("id"), uri.alias("uri"), F.coalesce(raw, F.lit(b"")).alias("raw"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("raw") - 1) / size).cast("int")))
    cut = numbered.select("record", "id", "uri", F.octet_length("raw").cast("long").alias("size"), F.posexplode(F.transform(starts, lambda i: F.substring("raw", i * size + 1, F.lit(size)))).alias("chunk", "body"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, held, one, two = None, 0, None, None
        for batch in batches:
            so_far, packed = [], []
            for r, body in zip(batch.column(0).to_pylist(), batch.column(5), strict=True):
                if r != record:
                    record, held, one, two = r, 0, hashlib.sha1(), hashlib.sha256()
                data = body.as_buffer()
                one.update(data)
                two.update(data)
                held += data.size
                packed.append(pa.compress(data, "zstd", asbytes=True))
                so_far.append((data.size, held, one.digest(), two.digest()))
            sizes, bytes_, sha1, sha256 = zip(*so_far, strict=True) if so_far else ((), (), (), ())
            last = [a == b for a, b in zip(bytes_, batch.column(3).to_pylist(), strict=True)]
            columns = [*batch.columns[:3], batch.column(4), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bytes_, pa.int64()), pa.array(sha1, pa.binary()), pa.array(sha256, pa.binary()), pa.array(last, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["record", "id", "uri", "chunk", "packed", "size", "bytes", "sha1", "sha256", "last"])

    return cut.mapInArrow(digest, "record long, id string, uri string, chunk int, packed binary, size int, bytes long, sha1 binary, sha256 binary, last boolean")


def unpacked(packed: bytes, size: int) -> bytes:
    """A chunk's bytes."""
    return pa.decompress(packed, size, "zstd", asbytes=True)


def record_kinds(chunks: DataFrame, least: int = 0, id_type: str = "long") -> DataFrame:
    """(record, id, uri, bytes, sha1, kind, refers_to, refers_record) of each record of a chunk table.

    Of records with equal payloads (by SHA-256 and length) of ``least`` bytes or more, that of the smallest id is a
    response, the first of its rows if it is repeated, and ids that are null come last; the others are revisits of it.
    """
    whole = chunks.where("last").select("record", "id", "uri", "bytes", "sha1", "sha256").withColumn("key", F.col("id").cast(id_type))
    first = F.min(F.struct(F.col("key").isNull().alias("no"), "key", "record", "id")).alias("first")
    groups = whole.where(F.col("bytes") >= least).groupBy("sha256", "bytes").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256", "bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    met = whole.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALT)).cast("int")).join(groups, ["sha256", "bytes", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    return met.select("record", "id", "uri", "bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.record")).alias("refers_record"))


def write_archives(chunks: DataFrame, kinds: DataFrame, path: str) -> None:
    """Write the records of a chunk table to archives below ``path``: each record's kind comes before its chunks in one
    shuffle by record, and a task writes what it reads."""
    heads = kinds.select("record", F.lit(-1).alias("chunk"), "kind", "id", "uri", "bytes", "sha1", "refers_to", "refers_record")
    both = heads.unionByName(chunks.select("record", "chunk", "packed", "size"), allowMissingColumns=True)
    chunks.sparkSession.dataSource.register(WarcSource)
    both.repartition("record").sortWithinPartitions("record", "chunk").write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records of the archives below ``path``, a row for each chunk: (id, uri, kind, refers_to, chunk, body, bytes,
    digest, last), as record_chunks has them, the digest in base32; of revisits, which hold no payload, one row with the length and digest of
    what they refer to. ``bodies``: False reads and checks the payloads, but leaves body null and gives last chunks only.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("bodies", str(bodies).lower()).load(path)


class WarcSource(DataSource):
    """Archives below a path. Options of reading: bodies; of writing: archive_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "id string, uri string, kind string, refers_to string, chunk int, body binary, bytes long, digest string, last boolean"

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("bodies", "true") == "true", int(self.options.get("chunk_bytes", CHUNK_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)), overwrite)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, limit: int, overwrite: bool):
        self.path, self.limit, self.overwrite = path, limit, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = filesystem(self.path)
        where.create_dir(f"{root}/_attempts", recursive=True)
        names: list[str] = []
        archive = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["chunk"] < 0:
                        if archive is None or archive.size >= self.limit:
                            if archive:
                                archive.close()
                            names.append(f"{uuid.uuid4().hex}.warc.gz")
                            archive = Archive(where.open_output_stream(f"{root}/_attempts/{names[-1]}", compression=None), names[-1])
                        archive.begin(row)
                    else:
                        archive.body(unpacked(row["packed"], row["size"]))
        finally:
            if archive:
                archive.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = filesystem(self.path)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.path.endswith(".warc.gz"):
                    where.delete_file(old.path)
        for m in messages:
            for name in m.files if m else ():
                where.move(f"{root}/_attempts/{name}", f"{root}/{name}")
        self._clear(where, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, where: fs.FileSystem, root: str) -> None:
        where.create_dir(root, recursive=True)
        if where.get_file_info(f"{root}/_attempts").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/_attempts")


def field(name: str, value: object) -> str:
    """A header line; none for null. Blanks and control characters of the value are percent-encoded."""
    return "" if value is None else f"{name}: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', str(value))}\r\n"


class Archive:
    """An archive that is written, one gzip member for each record."""

    def __init__(self, out, name: str):
        self.out, self.size, self.member, self.missing, self.skips = out, 0, None, 0, False
        self.date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        info = b"software: wikiloom\r\nformat: WARC File Format 1.1\r\n"
        self._open(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {self.date}\r\n{field('WARC-Filename', name)}Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode())
        self._put(info)

    def begin(self, row: dict) -> None:
        """The header of a record (kind, id, uri, bytes, sha1, refers_to, refers_record); a response's payload follows."""
        self._end()
        self.skips = row["kind"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
        self.missing = 0 if self.skips else row["bytes"]
        own = lambda n: None if n is None else f"<urn:wikiloom:record:{n}>"
        head = [
            VERSION + "\r\n", field("WARC-Type", row["kind"]), field("WARC-Record-ID", own(row["record"])), field("WARC-Date", self.date), field("WARC-Target-URI", row["uri"]),
            field("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}"), field("WARC-Refers-To", own(row["refers_record"])), field("WARC-Profile", REVISIT if self.skips else None),
            field("X-Row-Id", None if row["id"] is None else quote(row["id"], safe="")), field("X-Refers-To-Row-Id", None if row["refers_to"] is None else quote(row["refers_to"], safe="")), field("X-Payload-Length", row["bytes"]),
            "Content-Type: application/http;msgtype=response\r\n", field("Content-Length", len(http) + self.missing), "\r\n",
        ]
        self._open("".join(head).encode())
        self._put(http)

    def body(self, data: bytes) -> None:
        if not self.skips:
            self.missing -= len(data)
            self._put(data)

    def close(self) -> None:
        self._end()
        self.out.close()

    def _open(self, data: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(data)

    def _put(self, data: bytes) -> None:
        self._write(self.member.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _end(self) -> None:
        if self.member is None:
            return
        if self.missing:
            raise ValueError(f"a record's payload misses {self.missing} bytes")
        self._put(b"\r\n\r\n")
        self._write(self.member.flush())
        self.member = None


class WarcReader(DataSourceReader):
    """A task for each archive, which it reads from front to end; a payload that doesn't give its digest is an error."""

    NAMES = ("id", "uri", "kind", "refers_to", "chunk", "body", "bytes", "digest", "last")
    KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())

    def __init__(self, path: str, bodies: bool, chunk: int):
        self.path, self.bodies, self.chunk = path, bodies, chunk

    def partitions(self) -> list[InputPartition]:
        where, root = filesystem(self.path)
        found = sorted(x.path for x in where.get_file_info(fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", x.path))
        return [InputPartition(x) for x in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(partition.value) if partition.value else ():
            rows.append(row)
            held += len(row[5] or b"") + 500
            if held > SENT_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(self.NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.KINDS, strict=True)], names=self.NAMES)

    def _rows(self, path: str) -> Iterator[tuple]:
        where, _ = filesystem(self.path)
        with where.open_input_stream(path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            while head := self._head(stream):
                length, kind = int(head["content-length"]), head.get("warc-type", "")
                if kind in ("response", "revisit"):
                    yield from self._record(stream, head, kind, length)
                else:
                    while length:
                        length -= len(self._exact(stream, min(length, self.chunk)))
                self._exact(stream, 4)

    def _record(self, stream, head: dict[str, str], kind: str, length: int) -> Iterator[tuple]:
        """The rows of one record: its block is an HTTP header, an empty line, and the payload."""
        while (line := stream.readline()) not in (b"\r\n", b""):
            length -= len(line)
        length -= len(line)
        text = lambda name: unquote(head[name]) if name in head else None
        digest = head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None
        front = (text("x-row-id"), head.get("warc-target-uri"), kind, text("x-refers-to-row-id"))
        if kind == "revisit":
            while length:
                length -= len(self._exact(stream, min(length, self.chunk)))
            yield *front, 0, None, int(head["x-payload-length"]) if "x-payload-length" in head else None, digest, True
            return
        sha1, done, chunk = hashlib.sha1(), 0, 0
        while True:
            body = self._exact(stream, min(length - done, self.chunk))
            sha1.update(body)
            done += len(body)
            last = done == length
            if last and digest is not None and base32(sha1.digest()) != digest:
                raise ValueError(f"the payload of {head.get('warc-record-id')} isn't that of its digest")
            if self.bodies or last:
                yield *front, chunk, body if self.bodies else None, done, base32(sha1.digest()), last
            if last:
                return
            chunk += 1

    @staticmethod
    def _head(stream) -> dict[str, str]:
        """The header of the next record, names in small letters; empty at the archive's end."""
        if not stream.readline().startswith(b"WARC/"):
            return {}
        out = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(":")
            out[name.lower()] = value.strip()
        return out

    @staticmethod
    def _exact(stream, n: int) -> bytes:
        data = stream.read(n)
        while len(data) < n:
            more = stream.read(n - len(data))
            if not more:
                raise EOFError("an archive ends inside a record")
            data += more
        return data


def archive(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least: int = 0, path: str | None = None, size: int = CHUNK_BYTES) -> DataFrame:
    """Write a record for each row of ``df`` to archives below ``path`` (or the shared folder) and read them back: a row for
    each with id_col, payload_bytes, payload_digest (base32 SHA-1 of the full payload), record_type and refers_to.

    See record_chunks for nulls, empty and repeated rows, and record_kinds for which records are revisits. Ids are
    numbers or strings. An empty table writes no archive and gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    where = path or shared_path(spark, "archives")
    chunks = shared_table(record_chunks(df, id_col, payload_col, uri_col, size), "record-chunks")
    kinds = shared_table(record_kinds(chunks, least, kind), "record-kinds")
    write_archives(chunks, kinds, where)
    found = read_archives(spark, where, bodies=False).where("last")
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
