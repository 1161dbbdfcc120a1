"""WARC archives: written whole, normalised to a member per record, read back (operator 5).

Some crawlers compress an archive as one gzip stream, which can only be read from its
start. The normaliser inflates such a stream once, writes every record as a gzip member
of its own and a sidecar index of the members' offsets, so that any record can be read
by one seek.

Files go to the shared folder through pyarrow's file systems. A task names its files by
its attempt and hands their names on, so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepscope.llm.common import arrow_limits, stored, table
from stepscope.session import checkpoint_folder

PART_BYTES = 64 << 20  # payload of one archive; the next record begins another
CHUNK = 1 << 16  # bytes of an archive inflated at a time; they become 64 MB at the most
LEVEL = 1
ID = "<urn:page:%s>"
PAGE = re.compile(r"<urn:page:(-?\d+|none)>")
GZIP = 31  # zlib's window bits for a gzip stream
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAKS = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head without the payload."""
    name = "none" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ID % name}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ID % ('none' if refers_to is None else refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields in lower case and the block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    fields = {k.strip().lower(): v.strip() for k, _, v in named}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, rest[:size]


def page_of(name: str | None) -> int | None:
    found = PAGE.fullmatch(name or "")
    return int(found[1]) if found and found[1] != "none" else None


class Writer:
    """Writes records to one gzip stream per archive."""

    def __init__(self, folder: str):
        task = TaskContext.get()
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.stem = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}" if task else f"{folder}/part"
        self.n, self.out = 0, None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.stem}-{self.n:04d}.warc.gz"
            self.out = self.fs.open_output_stream(fs.FileSystem.from_uri(self.name)[1], compression=None)
            self.gzip, self.size, self.records = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
            self.n += 1
        self.out.write(self.gzip.compress(data))
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple[str, int] | None:
        if self.out is None:
            return None
        self.out.write(self.gzip.flush())
        self.out.close()
        self.out = None
        return self.name, self.records


def new_folder(spark, name: str) -> str:
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return folder


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload, revisit and refers_to.

    Of equal payloads of at least `least` bytes the one with the largest page_id is the
    response. A null html is an empty payload, a null page_id the smallest; rows repeated
    with the largest page_id are all responses.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    winners = rows.groupBy("sha1").agg(F.max("page_id").alias("winner"))
    revisit = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(winners, "sha1").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("winner")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write decided pages to archives of one gzip stream each: rows of archive and records."""
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = Writer(folder), []
        for batch in batches:
            for row in batch.to_pylist():
                writer.write(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"]))
                if writer.size >= PART_BYTES:
                    done.append(writer.close())
        done.append(writer.close())
        done = [d for d in done if d]
        yield pa.RecordBatch.from_pydict(
            {"archive": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())}
        )

    return stored(pages.mapInArrow(run, "archive string, records long"), "archives")


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Chunks of the content of a gzip file, of one or many members, inflated once."""
    gzip, begun = zlib.decompressobj(GZIP), False
    while data := read(CHUNK):
        while data:
            begun = True
            yield gzip.decompress(data)
            data = gzip.unused_data
            if gzip.eof:
                gzip, begun = zlib.decompressobj(GZIP), False
    if begun:
        raise EOFError("the archive ends inside a gzip stream")


def normalise_file(read: Callable[[int], bytes], write: Callable[[bytes], object]) -> list[dict]:
    """Rewrite each record of a gzip file as its own member; returns the offset index.

    A record's head has to fit into memory; its block passes through in chunks.
    """
    index, buffer, offset = [], bytearray(), 0
    chunks = inflated(read)

    def more() -> bool:
        got = next(chunks, None)
        buffer.extend(got or b"")
        return got is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if buffer.strip():
                raise EOFError("the archive ends inside a record's head")
            return index
        head = bytes(buffer[: end + 4])
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        left = end + 4 + int(fields["content-length"]) + 4
        gzip, start = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), offset
        while left:
            if not buffer and not more():
                raise EOFError("the archive ends inside a record")
            piece = bytes(buffer[:left])
            del buffer[: len(piece)]
            left -= len(piece)
            packed = gzip.compress(piece)
            offset += len(packed)
            write(packed)
        packed = gzip.flush()
        offset += len(packed)
        write(packed)
        index.append({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": start, "length": offset - start})


def one_file_a_task(files: DataFrame) -> DataFrame:
    """Deal file names out evenly; a file cannot be split, so tasks hold few of them."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, min(files.count(), 100_000)))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise the named archives: rows of archive, its sidecar index and records.

    The index has one JSON line per record: id, type, offset and length of the member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        n = 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                n += 1
                where = fs.FileSystem.from_uri(name)[1]
                source, path = fs.FileSystem.from_uri(archive)
                with source.open_input_stream(path, compression=None) as a, files.open_output_stream(where, compression=None) as b:
                    index = normalise_file(a.read, b.write)
                with files.open_output_stream(where + ".idx") as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [name], "index": [name + ".idx"], "records": pa.array([len(index)], pa.int64())})

    dealt = one_file_a_task(archives.select("archive"))
    return stored(dealt.mapInArrow(run, "archive string, index string, records long"), "normalised")


def read_back(normalised: DataFrame) -> DataFrame:
    """Read every record by its index entry and check its digest: one row per record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def row(data: bytes) -> dict:
        fields, block = parsed(data)
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        size = int(fields["warc-payload-length"])
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if digest_of(payload) != digest or len(payload) != size:
                raise ValueError(f"{fields['warc-record-id']} is damaged")
        return {
            "page_id": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for archive, index in zip(*(batch.column(i).to_pylist() for i in range(2))):
                files, path = fs.FileSystem.from_uri(archive)
                rows = []
                with files.open_input_file(path) as a, files.open_input_stream(fs.FileSystem.from_uri(index)[1]) as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        a.seek(entry["offset"])
                        rows.append(row(zlib.decompress(a.read(entry["length"]), GZIP)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return one_file_a_task(normalised.select("archive", "index")).mapInArrow(run, schema)


def op5_warc_normalise(spark, sf_dir: str) -> DataFrame:
    pages = decided(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = write_archives(pages, new_folder(spark, "warc"))
    return read_back(normalise(archives, new_folder(spark, "warc-members")))


OP5_SQL = """
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
    FROM pages),
digits AS (
    SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS quads
    FROM rows)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(quads, lambda q:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 15) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 10) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 5) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM digits
"""
