"""WARC archives: a monolithic gzip normaliser with a sidecar offset index.

Records are written as archives of one gzip stream each, the form that some crawlers
leave and that no reader can enter in the middle. The normaliser inflates such a file
once, as a stream, writes every record again as a gzip member of its own, and beside
the file an index of the members. A record is then read by seeking to its member.

Archives lie in the shared folder and are reached by pyarrow's file systems, which
open the same addresses as Spark's. A file is written under a passing name and moved
to its own when whole; only files that a completed task names are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.session import fresh_path, written

GZIP = 31  # zlib's window bits for gzip streams
BLOCK = 1 << 20
LEAST_BYTES = 0
SPREAD = 16
RECORDS_PER_FILE = 5_000
HEAD_END = b"\r\n\r\n"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class _Written:
    """A file that appears under its name when all of it is there."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path, self.part = files, path, f"{path}.{uuid.uuid4().hex}"
        self.out = files.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.part, self.path)


# --- records -----------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, target: str, kind: str, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and names digest and size of the full payload."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head.insert(3, f"WARC-Refers-To: <{refers}>")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + HEAD_END + block + HEAD_END


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file, whether of one member or many; never more than BLOCK at a time."""
    inflate = zlib.decompressobj(GZIP)
    for data in blocks:
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            yield inflate.decompress(data, BLOCK)
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    rest = inflate.flush()
    if rest:
        yield rest
    if not inflate.eof:
        raise ValueError("the gzip stream is cut off")


def records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of every record in a stream of plain bytes."""
    held = bytearray()
    for data in plain:
        held += data
        while True:
            at = held.find(HEAD_END)
            if at < 0:
                break
            fields = fields_of(bytes(held[:at]))
            end = at + 2 * len(HEAD_END) + int(fields["content-length"])
            if len(held) < end:
                break
            yield fields, bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError("the last record is cut off")


def _blocks(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    with files.open_input_stream(path, compression=None) as f:
        while data := f.read(BLOCK):
            yield data


# --- tasks -------------------------------------------------------------------


def _written_archives(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write the rows of a task as archives of one gzip stream; gives their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        part, number, inside, out, squeeze = TaskContext.get().partitionId(), 0, 0, None, None
        done: list[str] = []
        attempt = uuid.uuid4().hex  # files of lost attempts stay unread

        def finish() -> None:
            out.write(squeeze.flush())
            out.close()
            done.append(name)

        rows = (row for batch in batches for at in range(0, batch.num_rows, 200) for row in batch.slice(at, 200).to_pylist())
        for row in rows:
            if out is None:
                name = f"part-{part:06d}-{number:06d}-{attempt}.warc.gz"
                out, squeeze = _Written(files, f"{root}/{name}"), zlib.compressobj(6, zlib.DEFLATED, GZIP)
            payload = (row["html"] or "").encode()
            kind = "revisit" if row["refers_to"] is not None else "response"
            refers = None if row["refers_to"] is None else f"urn:page:{row['refers_to']}"
            page = "" if row["page_id"] is None else row["page_id"]
            target = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
            out.write(squeeze.compress(record(f"urn:page:{page}", target, kind, payload, digest_of(payload), len(payload), refers)))
            inside += 1
            if inside == RECORDS_PER_FILE:
                finish()
                out, inside, number = None, 0, number + 1
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    return run


def _normalised(source: str, target: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rewrite archives with one member per record, and write `<name>.idx` beside each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, root), (to_files, to) = _opened(source), _opened(target)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out = _Written(to_files, f"{to}/{name}")
                index = []
                for fields, whole in records(inflated(_blocks(files, f"{root}/{name}"))):
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    member = squeeze.compress(whole) + squeeze.flush()
                    index.append((fields["warc-record-id"], out.size, len(member)))
                    out.write(member)
                out.close()
                side = _Written(to_files, f"{to}/{name}.idx")
                for entry in index:
                    side.write(json.dumps(entry).encode() + b"\n")
                side.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([out.size], pa.int64())],
                    ["name", "records", "bytes"],
                )

    return run


def _read_back(folder: str, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Read every record by its index entry: seek, inflate the member, check the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                index = b"".join(_blocks(files, f"{root}/{name}.idx")).splitlines()
                rows = []
                with files.open_input_file(f"{root}/{name}") as f:
                    for line in index:
                        record_id, offset, length = json.loads(line)
                        f.seek(offset)
                        plain = zlib.decompressobj(GZIP).decompress(f.read(length))
                        at = plain.index(HEAD_END)
                        fields = fields_of(plain[:at])
                        payload = plain[at + len(HEAD_END) : -len(HEAD_END)]
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        kind = fields["warc-type"]
                        if fields["warc-record-id"] != record_id or kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                            raise ValueError(f"{name}: the record at {offset} is not what the index or its head says")
                        page = record_id.removeprefix("<urn:page:").removesuffix(">")
                        refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, name, offset))
                kinds = (id_type, pa.int64(), pa.string(), pa.string(), id_type, pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset"]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


# --- jobs --------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives of one gzip stream each; gives (name) of the files.

    Of pages with equal payloads of at least `least_bytes`, that with the largest id is
    a response and the others revisit it. Rows that repeat the largest id are responses.
    A page without id is a response only if no page of its payload has an id.
    """
    rows = pages.select("page_id", "url", "html").withColumn("body", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = rows.select("page_id", "url", "html", F.sha1("body").alias("sum"), F.octet_length("body").alias("n"))
    # Pages of one payload, null ones for instance, may be a large share: they meet their best id in SPREAD places.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int"))
    best = rows.groupBy(F.col("sum").alias("same")).agg(F.max("page_id").alias("best"))
    best = best.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    joined = rows.join(best, (F.col("sum") == F.col("same")) & (F.col("salt") == F.col("place")))
    other = F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("best")))
    refers = F.when(other & (F.col("n") >= least_bytes), F.col("best"))
    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    out = joined.select("page_id", "url", "html", refers.alias("refers_to"))
    return written(out.mapInArrow(_written_archives(folder), "name string"), "archives")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the files `archives` (name) of `source` into `target`; gives (name, records, bytes)."""
    files, root = _opened(target)
    files.create_dir(root, recursive=True)
    some = _dealt(archives)
    return written(some.mapInArrow(_normalised(source, target), "name string, records long, bytes long"), "members")


def _dealt(names: DataFrame) -> DataFrame:
    """Names of archives, as many partitions as names; adaptive execution would merge a few bytes into one task.

    Dealt by a hash of the name: by the name itself, as `distinct` deals them already, the
    planner may take the second deal for the first and leave it out.
    """
    some = names.select("name").distinct()
    return some.repartition(max(1, some.count()), F.xxhash64("name"))


def read_archives(members: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the files `members` (name) in `folder`, found by its index entry."""
    kind = pa.int32() if id_type == "int" else pa.int64()
    schema = (
        f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type},"
        " archive string, member_offset long"
    )
    return _dealt(members).mapInArrow(_read_back(folder, kind), schema)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html), normalise the archives and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to,
    archive, member_offset. A null html is an empty payload. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    raw, clean = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    members = normalise(write_archives(pages, raw, least_bytes), raw, clean)
    return read_archives(members, clean, kind)
