"""WARC archives: a writer with one gzip member per record, and a reader that splits archives anywhere.

Writing: pages with equal payloads form a group, of which the one with the smallest page_id is stored whole (`response`) and
the others refer to it (`revisit`, headers only). Groups meet as digests only. Every task writes files of its own, under
names that no other attempt uses; the table of written files is what the successful tasks return, so a lost executor or a
repeated task leaves nothing that is read.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its range, accepts a place as a member only if it
decodes to a WARC header, and then goes on from member to member. It owns the records that start in its range
and reads past its end to finish the last one; a range in which none starts is empty. The table of written files holds how
many records start in each stretch of `range_bytes`; a range of the same size in which another number is found raises.

Odd cases: a null html is an empty payload. Rows that share the smallest page_id of a group are all responses. A null page_id
is larger than all others; a group without any other has only responses. Records of any size are read in pieces, one record
at a time in memory. Bytes between members are skipped; a record that breaks off, lacks a field, or whose payload has another
digest than its header says, raises ValueError wherever it stands, and so does a file shorter than its table says. (In files
of others, a record after padding or at the start of a range of which less is left than decodes to `WARC/1.` looks like noise.)
An empty table writes and reads nothing. Archives lie on a disk that
all tasks share (a path or file://), or in a store that pyarrow opens by its URI: s3:// (s3a:// and s3n:// are taken for it),
gs://, hdfs:// or viewfs://, abfs:// and abfss://. Another scheme is refused before anything is written. Extra columns are ignored. (An archive stored
unpacked inside another one's payload could pass for records where a range starts inside it; html in UTF-8 cannot hold one,
as the magic isn't UTF-8.)
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crowdlens.llm import frames
from crowdlens.session import stage, stage_path

MAGIC = b"\x1f\x8b\x08"
MARK = b"WARC/1."
#: Most tasks that read, unless the cluster runs more at once.
RANGE_TASKS = 20_000
READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
FILES = "path string, bytes long, records long, range_bytes long, starts array<long>"


# ---------------------------------------------------------------- records

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{of}')}>"


def _value(text: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def record(page: int | None, url: str | None, payload: bytes, first: int | None, is_response: bool, date: str) -> bytes:
    """One uncompressed record; `first` is the page whose record a revisit refers to."""
    of = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", record_id(page, of)),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{of}"),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", _value(url)))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if not is_response:
        fields += [("WARC-Refers-To", record_id(first, of)), ("X-Refers-To-Page-Id", str(first)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def parse(data: bytes) -> dict:
    """A row of READ from one uncompressed record; ValueError if it isn't one, or not whole."""
    head, mark, block = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = _fields(head)
    if lacking := {"content-length", "warc-payload-digest", "warc-type"} - fields.keys():
        raise ValueError(f"the record lacks {', '.join(sorted(lacking))}")
    size = int(fields["content-length"])
    if len(block) != size + 4:
        raise ValueError("the record breaks off")
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    of = fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-type"] == "response":
        if digest(payload) != of:
            raise ValueError("the payload has another digest than its header says")
        length, kept = len(payload), payload
    else:
        length, kept = int(_fields(http)["content-length"]), None
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {"page_id": int(page) if page else None, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "payload_digest": of, "payload_bytes": length, "refers_to": int(refers) if refers else None, "payload": kept}


# ---------------------------------------------------------------- writing

@dataclass(frozen=True)
class Settings:
    file_bytes: int = 256 << 20  # a file is closed once it has grown to this
    range_bytes: int = 8 << 20
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


#: Schemes of Spark's folders and those under which pyarrow knows the same stores.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs",
           "abfs": "abfs", "abfss": "abfss"}


def store_uri(folder: str) -> str:
    """`folder` as pyarrow names it; ValueError for a store that it can't open."""
    scheme, mark, rest = folder.partition("://")
    if not mark:
        scheme, mark, rest = folder.partition(":/") if folder.startswith("file:/") else ("", "", folder)
        rest = "/" + rest.lstrip("/") if mark else rest
    if scheme not in SCHEMES or not (mark or rest.startswith("/")):
        raise ValueError(f"archives can't be kept in {folder}: use an absolute path or one of {', '.join(x for x in SCHEMES if x)}")
    return f"{SCHEMES[scheme]}://{rest}"


def _opened(uri: str):
    """(store, path in it) of a URI as `store_uri` gives it. Paths are taken as they are, not as parts of an URI with escapes."""
    scheme, _, rest = uri.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives under `folder`, a URI that all tasks can reach. Returns the staged
    table of files: path, bytes, records, and range_bytes with the number of records that start in each stretch of so many
    bytes (`starts`)."""
    folder = store_uri(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html).alias("of"))
    shared = stage(rows.groupBy("of").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("of").alias("_of"), "first"), "warc-shared")
    judged = rows.join(frames.small_side(shared, 200_000), F.col("of") == F.col("_of"), "left")
    is_response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    judged = judged.select("page_id", "url", "html", "first", is_response.alias("whole"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        sink, path, size, starts, done = None, "", 0, Counter(), []
        for batch in batches:
            for page, url, text, first, whole in zip(*[column.to_pylist() for column in batch.columns]):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"  # the whole URI, so that a reader opens the same store
                    sink, size, starts = store.open_output_stream(f"{root}/{name}", compression=None), 0, Counter()
                data = member(record(page, url, text.encode(), first, whole, settings.date), settings.level)
                sink.write(data)
                starts[size // settings.range_bytes] += 1
                size += len(data)
                if size >= settings.file_bytes:
                    sink.close()
                    done.append((path, size, starts))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, size, starts))
        for path, size, starts in done:
            yield pa.RecordBatch.from_pydict({
                "path": [path], "bytes": [size], "records": [starts.total()], "range_bytes": [settings.range_bytes],
                "starts": [[starts[i] for i in range(-(-size // settings.range_bytes))]]})
    return stage(frames.map_rows(judged, task, FILES), "warc-files")


# ---------------------------------------------------------------- reading

class Window:
    """A file seen through one buffer that only grows while a record needs it."""

    def __init__(self, source, size: int, step: int = 1 << 20):
        self.source, self.size, self.step, self.base, self.data = source, size, step, 0, b""

    def at(self, position: int, wanted: int) -> memoryview:
        """Bytes from `position`, `wanted` of them or fewer at the end of the file."""
        wanted = max(0, min(wanted, self.size - position))
        if not (self.base <= position and position + wanted <= self.base + len(self.data)):
            self.source.seek(position)
            self.data, self.base = self.source.read(max(wanted, min(self.step, self.size - position))), position
        return memoryview(self.data)[position - self.base: position - self.base + wanted]


def decode(window: Window, position: int) -> tuple[bytes, int]:
    """The record of the member at `position`, and where the member ends; ValueError if none is there, or not whole."""
    unpacker, out, at = zlib.decompressobj(31), bytearray(), position
    while not unpacker.eof:
        piece = window.at(at, 1 << 16)
        if not len(piece):
            raise ValueError("the member breaks off")
        try:
            out += unpacker.decompress(piece)
        except zlib.error as error:
            raise ValueError(f"no member: {error}") from error
        if out[: len(MARK)] != MARK[: len(out)]:
            raise ValueError("no record")
        at += len(piece) - len(unpacker.unused_data)
    return bytes(out), at


def starts_record(window: Window, position: int) -> bool:
    """Whether the member at `position` decodes to a WARC header with type and length. Whatever else may be damaged: once its
    first bytes are those of a header, so that a header which breaks off is a record, too."""
    unpacker, out, at = zlib.decompressobj(31), b"", position
    while b"\r\n\r\n" not in out and not unpacker.eof:
        piece = window.at(at, 1 << 10)
        begun = out.startswith(MARK)
        if not len(piece):
            return begun or position == 0  # nothing but a record can break off at the start of a file
        try:
            out += unpacker.decompress(piece, 1 << 10 if begun else len(MARK) - len(out))
        except zlib.error:
            return begun
        if out[: len(MARK)] != MARK[: len(out)]:
            return False
        at += len(piece) - len(unpacker.unconsumed_tail) - len(unpacker.unused_data)
    head, mark, _ = out.partition(b"\r\n\r\n")
    return bool(mark) and {"warc-type", "content-length"} <= _fields(head).keys()


def next_member(window: Window, position: int, end: int) -> int | None:
    """First place from `position` and before `end` where a record starts, whole or damaged."""
    while position < end:
        piece = bytes(window.at(position, 1 << 16))
        found = piece.find(MAGIC)
        if found < 0:
            position += max(1, len(piece) - len(MAGIC) + 1)
            continue
        position += found
        if position >= end:
            return None
        if starts_record(window, position):
            return position
        position += 1  # the magic stood inside packed data
    return None


def read_range(source, size: int, start: int, end: int, expected: int | None = None) -> Iterator[dict]:
    """Rows of the records that start in [start, end); ValueError if they aren't `expected` ones."""
    window, found = Window(source, size), 0
    position = next_member(window, start, end)
    while position is not None and position < end:
        if bytes(window.at(position, len(MAGIC))) != MAGIC:
            position = next_member(window, position, end)
            continue
        data, after = decode(window, position)
        yield parse(data)
        position, found = after, found + 1
    if expected is not None and found != expected:
        raise ValueError(f"{found} records instead of {expected} start in bytes {start} to {end}")


def read(spark: SparkSession, files: DataFrame, settings: Settings = Settings(), with_payload: bool = True) -> DataFrame:
    """All records of the archives in `files` (path, bytes), one row of READ each; payload is null for revisits. With
    `starts` and `range_bytes` as from `write`, the number of records is checked in every range of that size."""
    schema = READ if with_payload else READ.rpartition(",")[0]
    columns = [part.split()[0] for part in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    step = settings.range_bytes
    known = F.lit(None).cast("long")
    if {"starts", "range_bytes"} <= set(files.columns):
        known = F.when(F.col("range_bytes") == step, F.get("starts", (F.col("start") / step).cast("int")))
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("long")))).select("path", "bytes", "start", known.alias("known"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, known in zip(*[column.to_pylist() for column in batch.columns]):
                store, place = _opened(store_uri(path))
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    if source.size() < size:
                        raise ValueError(f"{path} has {source.size()} bytes instead of {size}")
                    for row in read_range(source, size, start, min(start + step, size), known):
                        rows.append(row)
                        held += len(row["payload"] or b"") if with_payload else 100
                        if held >= 4 << 20:
                            yield _rows(rows, columns, kinds)
                            rows, held = [], 0
                yield _rows(rows, columns, kinds)
    # A range is a small row but much work: left to itself, Spark would give them all to one task.
    parts = max(1, min(ranges.count(), max(spark.sparkContext.defaultParallelism, RANGE_TASKS)))
    number = F.row_number().over(W.partitionBy("path").orderBy("start")) + F.pmod(F.xxhash64("path"), F.lit(parts))
    dealt = ranges.withColumn("part", F.pmod(number, F.lit(parts)).cast("int")).repartitionById(parts, "part").drop("part")
    return frames.map_rows(dealt, task, schema)


def _rows(rows: list[dict], columns: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[name] for row in rows], kinds.get(name, pa.string())) for name in columns], names=columns)


def round_trip(pages: DataFrame, settings: Settings = Settings(), with_payload: bool = True) -> DataFrame:
    """Write `pages` into the shared folder and read the archives back."""
    spark = pages.sparkSession
    return read(spark, write(pages, stage_path(spark, "warc"), settings), settings, with_payload)
