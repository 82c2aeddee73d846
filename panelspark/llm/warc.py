"""Web archives: one gzip member per record, written and read by Spark as the data source ``warc``.

A folder holds archives (``*.warc.gz``) and one ``_commit-*.json`` per write that names the archives which count.
Tasks write under fresh names and the driver writes the list at the end, so what a lost or repeated task leaves
behind is never read. The reader walks an archive from its start: it inflates one member a chunk at a time, takes
the header, then as many bytes as Content-Length says, and compares the digests with those of the header.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from panelspark.llm.common import bounded_broadcast, small_batches
from panelspark.session import materialize

#: equal payloads of fewer bytes are not replaced by a reference
MIN_REVISIT_BYTES = 0
LEVEL = 6
#: an archive is closed beyond so many bytes
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 18
HEADER_LIMIT = 1 << 20
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"

# Names that the archive format prescribes.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = (
    "page_id long, url string, html string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, file string, offset long"
)
CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f]")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{uid}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "none" else int(page)


# ---- records -----------------------------------------------------------------------------------


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A whole record as one gzip member; equal records give equal bytes."""
    digest = base32(hashlib.sha1(block).hexdigest())
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def page_member(row: dict, level: int = LEVEL) -> bytes:
    """The record of one page: a response, or a revisit without payload where ``refers_uid`` names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    again = row["refers_uid"] is not None
    headers = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["uid"])),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}"),
    ]
    if row["url"] is not None:
        # a line break in an address would end the header
        address = CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"])
        headers.insert(2, ("WARC-Target-URI", address))
    if again:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(row["refers_to"], row["refers_uid"]))]
    return member(headers, http if again else http + row["payload"], level)


class Damaged(ValueError):
    """An archive that does not hold what its headers say."""


class Members:
    """The gzip members of a stream one behind the other, inflated a chunk at a time."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.raw, self.taken = stream, chunk, b"", 0

    def fill(self) -> bytes:
        data = self.raw or self.stream.read(self.chunk)
        self.raw = b""
        self.taken += len(data)
        return data

    def pieces(self) -> Iterator[bytes]:
        """The bytes of the next member; none at the end of the stream."""
        inflate = zlib.decompressobj(31)
        data = self.fill()
        if not data:
            return
        while True:
            try:
                piece = inflate.decompress(data, self.chunk)
            except zlib.error as e:
                raise Damaged(f"no gzip member before byte {self.taken}: {e}") from e
            if piece:
                yield piece
            if inflate.eof:
                self.raw = inflate.unused_data
                self.taken -= len(self.raw)
                return
            data = inflate.unconsumed_tail or self.fill()
            if not data and not piece:
                raise Damaged(f"the archive ends inside a member, at byte {self.taken}")


class Cursor:
    """Bytes of one member by length or up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.source, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.source, b"")
        self.held += piece
        return bool(piece)

    def until(self, mark: bytes, limit: int) -> bytes:
        """The bytes up to ``mark``, with it; the mark must end within ``limit`` bytes."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)), limit)) < 0:
            seen = len(self.held)
            if seen >= limit or not self.more():
                raise Damaged("a header has no end")
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def some(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes; none at the end of the member."""
        if not self.held and not self.more():
            return b""
        out, self.held = self.held[:n], self.held[n:]
        return out


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    offset: int
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


def fields(lines: bytes) -> dict[str, str]:
    """Names in lower case and values of header lines behind the first one."""
    found = [line.partition(":") for line in lines.decode().split("\r\n")[1:] if line]
    return {k.strip().lower(): v.strip() for k, _, v in found}


def read_records(stream, keep_payload: bool = True, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order. Memory holds one chunk, and the payload of one record if it is kept.

    A member that is cut off, framed wrongly or whose bytes differ from a digest in its header raises ``Damaged``.
    """
    members = Members(stream, chunk)
    while True:
        offset = members.taken
        cursor = Cursor(members.pieces())
        if not cursor.more():
            return
        head = cursor.until(b"\r\n\r\n", HEADER_LIMIT)
        if not head.startswith(b"WARC/"):
            raise Damaged(f"no record at byte {offset}")
        headers = fields(head)
        try:
            left = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise Damaged(f"no length in the record at byte {offset}") from e
        block, payload, kept, size, http = hashlib.sha1(), hashlib.sha1(), [], 0, {}
        if headers.get("content-type", "").startswith("application/http"):
            lines = cursor.until(b"\r\n\r\n", left)
            block.update(lines)
            left -= len(lines)
            http = fields(lines)
        while left:
            data = cursor.some(left)
            if not data:
                raise Damaged(f"the record at byte {offset} is shorter than its length")
            left -= len(data)
            size += len(data)
            block.update(data)
            payload.update(data)
            if keep_payload:
                kept.append(data)
        end = b""
        while data := cursor.some(CHUNK):
            end += data
        if end != b"\r\n\r\n":
            raise Damaged(f"the record at byte {offset} is longer than its length")
        kind, digest = headers.get("warc-type"), base32(payload.hexdigest())
        said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers.get("warc-block-digest", f"sha1:{base32(block.hexdigest())}") != f"sha1:{base32(block.hexdigest())}":
            raise Damaged(f"the block of the record at byte {offset} does not match its digest")
        if kind == "revisit":
            # the payload stands in another record; length and digest are those that the response had
            size, digest = int(http["content-length"]), said
        elif said and said != digest:
            raise Damaged(f"the payload of the record at byte {offset} does not match its digest")
        yield Record(headers, http, offset, b"".join(kept) if keep_payload and kind != "revisit" else None, size, digest)


# ---- data source -------------------------------------------------------------------------------


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


@dataclass
class Archive(InputPartition):
    file: str


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level = options["path"], int(options.get("level", LEVEL))
        self.bytes, self.overwrite = int(options.get("archivebytes", ARCHIVE_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = place(self.path)
        system.create_dir(base, recursive=True)
        files, sink, name, rows, size = [], None, "", 0, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    name, rows, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size += sink.write(member(headers, info, self.level))
                size += sink.write(page_member(row, self.level))
                rows += 1
                if size >= self.bytes:
                    sink.close()
                    files.append((name, rows, size))
                    sink = None
        if sink is not None:
            sink.close()
            files.append((name, rows, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the archives of the tasks that succeeded: one entry per archive."""
        system, base = place(self.path)
        system.create_dir(base, recursive=True)
        old = commits(system, base) if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.files]
        name = f"_commit-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{base}/.{name}") as sink:
            sink.write(json.dumps([{"file": f, "records": r, "bytes": b} for f, r, b in sorted(files)]).encode())
        system.move(f"{base}/.{name}", f"{base}/{name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = place(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                system.delete_file(f"{base}/{name}")


def commits(system: fs.FileSystem, base: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_commit-"))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[Archive]:
        system, base = place(self.path)
        names = []
        for path in commits(system, base):
            with system.open_input_stream(path) as f:
                names += [x["file"] for x in json.loads(f.read())]
        return [Archive(n) for n in names] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, base = place(self.path)
        rows, held = [], 0
        with system.open_input_stream(f"{base}/{partition.file}", compression=None) as stream:
            for r in read_records(stream, self.payload):
                kind = r.headers.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                to = r.headers.get("warc-refers-to")
                rows.append({
                    "page_id": page_of(r.headers["warc-record-id"]), "url": r.headers.get("warc-target-uri"),
                    "html": None if r.payload is None else r.payload.decode(), "record_type": kind, "payload_bytes": r.payload_bytes,
                    "payload_digest": r.payload_digest, "refers_to": page_of(to) if to else None, "file": partition.file, "offset": r.offset,
                })
                held += 256 + len(r.payload or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())]
)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``.

    Options: ``path``; reading: ``payload`` (false leaves html null, digests are verified all the same); writing:
    ``level``, ``archivebytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


# ---- operators ---------------------------------------------------------------------------------


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row per page and record: page_id, uid, url, payload (null for a revisit), payload_bytes, sha1, refers_to, refers_uid.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is the response; a
    missing page_id comes last, and of rows that share it the one read first. Payloads are equal when their SHA-256 is.
    Null html is an empty payload. The rows are written once with a number of their own; only narrow columns are
    grouped and joined, by a minimum that pre-aggregates and a join that splits hot payloads.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({
        "uid": F.monotonically_increasing_id(), "sha1": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256)),
        "payload_bytes": F.octet_length("payload").cast("long"),
    })
    rows = materialize(rows, "pages")
    at = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    heads = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("same").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    heads = materialize(heads.where("n > 1").select("same", F.col("first.page_id").alias("refers_to"), F.col("first.uid").alias("refers_uid")), "heads")
    again = rows.select("uid", "same").join(bounded_broadcast(heads), "same").where("uid <> refers_uid").drop("same")
    again = materialize(again, "revisits")
    out = rows.drop("same").join(bounded_broadcast(again), "uid", "left")
    return out.withColumn("payload", F.when(F.col("refers_uid").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, mode: str = "append", **options) -> None:
    """Write ``pages`` (page_id, url, html) as archives in the folder ``path``.

    Other columns are ignored; control characters and blanks of an address are percent-encoded; a null address has no
    header. An empty table writes a list of no archives. Pages without html, equal rows and very long pages are records
    like any other. A task that runs again writes archives of its own, and the list names those of one run alone.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = small_batches(page_records(pages, min_bytes))
    rows.write.format("warc").mode(mode).options(**options).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The pages of the archives in ``path``: page_id, url, html (null for revisits, and without ``payload``), record_type,
    payload_bytes, payload_digest, refers_to, file, offset. Every digest is verified; one task reads one archive."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_digests(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives of ``pages``."""
    write_archives(pages, path, min_bytes)
    found = read_archives(pages.sparkSession, path, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i : list_aggregate(list_transform([15, 10, 5, 0],
    lambda s : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((concat('0x', substr(d, 5 * i + 1, 5))::BIGINT >> s) & 31)::INT + 1, 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
