"""A keyed message log in a shared folder, read as a stream with partitions and offsets.

A log has a fixed number of partitions. Messages of one key go to one partition and keep their order; each has the next offset of
its partition. A file holds a run of offsets and is named by the first and the one after the last, so the head of the log is
known from the names alone. Files appear whole, in order, or not at all (they are renamed when complete), and an offset is never reused.

The reader starts at the beginning or at the head, hands over at most `maxPerBatch` messages at a time, and, where `minPerBatch` is set,
waits until so many are there or the oldest has waited `maxDelay` seconds. What it has planned is kept in `position`, so that a
restarted reader goes on from there; Spark's own checkpoint decides what is read again.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from crowdlens.session import ship_package, stage

FORMAT = "message_log"
SCHEMA = "key string, value string, partition int, offset bigint"
ARROW = pa.schema([("key", pa.string()), ("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())])
_NAME = re.compile(r"partition=(\d+)/(\d{20})-(\d{20})\.parquet$")
_BATCH = 4_096
#: Messages that a task sorts and writes as one file.
SLICE = 500_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A local or mounted folder, or one of a store that pyarrow knows."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def segments(folder: str) -> dict[int, list[tuple[int, int, str]]]:
    """For each partition its (first offset, offset after the last, path), in order."""
    store, root = opened(folder)
    found: dict[int, list] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if m := _NAME.search(info.path):
            found.setdefault(int(m[1]), []).append((int(m[2]), int(m[3]), info.path))
    return {partition: sorted(files) for partition, files in found.items()}


def head(folder: str) -> dict[int, int]:
    """Offset after the last message of each partition that has any."""
    return {partition: files[-1][1] for partition, files in segments(folder).items()}


def append(messages: DataFrame, folder: str, partitions: int = 4, order: tuple = ()) -> dict[int, int]:
    """Append (key, value) messages, within a partition in `order` (columns of `messages`, else as they come), and return the new head.

    One writer at a time. A partition is cut into slices by its order; each is sorted and written by a task of its own, which holds about
    `SLICE` messages however many there are. The files are renamed here, in the order of the slices, when all are complete.
    """
    ship_package(messages.sparkSession)
    before = head(folder)
    dealt = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    if not order:
        dealt, order = dealt.withColumn("_arrival", F.monotonically_increasing_id()), ("_arrival",)
    slices = max(partitions, -(-messages.count() // SLICE))
    rows = dealt.repartitionByRange(slices, "partition", *order).sortWithinPartitions("partition", *order).select("key", "value", "partition")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, root = opened(folder)
        current, sink, n, path, place = None, None, 0, "", TaskContext.get().partitionId()

        def close():
            sink.close()
            return pa.RecordBatch.from_pydict({
                "partition": pa.array([current], pa.int32()), "slice": pa.array([place], pa.int32()), "n": [n], "path": [path]})
        for batch in batches:
            for own in _by_partition(batch):
                number = own.column("partition")[0].as_py()
                if number != current:
                    if sink is not None:
                        yield close()
                    current, n = number, 0
                    store.create_dir(f"{root}/partition={current}", recursive=True)
                    path = f"{root}/partition={current}/.{place:06d}-{uuid.uuid4().hex}.tmp"
                    sink = pq.ParquetWriter(path, ARROW, filesystem=store)
                # Counted from the file's first message: how many are in the slices before is known when all are written.
                numbers = pa.array(range(n, n + own.num_rows), pa.int64())
                sink.write_batch(pa.RecordBatch.from_arrays([*own.columns, numbers], schema=ARROW))
                n += own.num_rows
        if sink is not None:
            yield close()
    done = stage(rows.mapInArrow(write, "partition int, slice int, n bigint, path string"), "message-log")
    store, root = opened(folder)
    now, ready = dict(before), []
    for row in done.orderBy("partition", "slice").collect():
        p, low = row["partition"], now.get(row["partition"], 0)
        now[p] = low + row["n"]
        ready.append((row["path"], low, f"{root}/partition={p}/{low:020d}-{now[p]:020d}.parquet"))
    later = [(path, low) for path, low, _ in ready if low]

    def renumber(part: tuple[str, int]) -> None:
        path, offset = part
        store, _ = opened(folder)
        with store.open_input_file(path) as source, pq.ParquetWriter(f"{path}.{offset}", ARROW, filesystem=store) as sink:
            for batch in pq.ParquetFile(source).iter_batches(_BATCH):
                numbers = pa.array(range(offset, offset + batch.num_rows), pa.int64())
                sink.write_batch(pa.RecordBatch.from_arrays([*batch.columns[:3], numbers], schema=ARROW))
                offset += batch.num_rows
    if later:
        messages.sparkSession.sparkContext.parallelize(later, len(later)).foreach(renumber)
    for path, low, name in ready:
        store.move(f"{path}.{low}" if low else path, name)
        if low:
            store.delete_file(path)
    return now


def _by_partition(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one partition; rows come sorted by it."""
    numbers = batch.column("partition").to_pylist()
    low = 0
    for high in range(1, len(numbers) + 1):
        if high == len(numbers) or numbers[high] != numbers[low]:
            yield batch.slice(low, high - low)
            low = high


class LogSource(DataSource):
    """`spark.readStream.format("message_log")` with path, startingOffsets (earliest, latest), maxPerBatch, minPerBatch, maxDelay
    and position (a file)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(dict(self.options))


class Stretch(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        given = {name.lower(): value for name, value in options.items()}
        self.path = given["path"]
        self.start = given.get("startingoffsets", "latest")
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets is earliest or latest, not {self.start!r}")
        self.most = int(given.get("maxperbatch", 0))
        self.least = int(given.get("minperbatch", 0))
        self.delay = float(given.get("maxdelay", 0))
        self.position = given.get("position")
        self.planned, self.initial = self._kept(), None
        self.waiting_since = None

    def _kept(self) -> dict[int, int] | None:
        if not self.position:
            return None
        store, path = opened(self.position)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_file(path) as source:
            return {int(p): n for p, n in json.loads(source.read()).items()}

    def _keep(self) -> None:
        if self.position:
            store, path = opened(self.position)
            with store.open_output_stream(f"{path}.new") as sink:
                sink.write(json.dumps(self.planned).encode())
            store.move(f"{path}.new", path)

    def _first(self) -> dict[int, int]:
        """Where a stream without a checkpoint starts; Spark may ask for it after the first end."""
        if self.initial is None:
            self.initial = {} if self.start == "earliest" else head(self.path)
        return self.initial

    def initialOffset(self) -> dict:
        if self.planned is None:
            self.planned = dict(self._first())
        return {str(p): n for p, n in self._first().items()}

    def latestOffset(self) -> dict:
        now = head(self.path)
        if self.planned is None:
            # Without a position a restart can't be told from a start: this first batch then has no bound.
            self._first()
            self.planned = dict(self.initial if self.position else now)
            self._keep()
        behind = {p: n - self.planned.get(p, 0) for p, n in now.items() if n > self.planned.get(p, 0)}
        if behind:
            self.waiting_since = self.waiting_since or time.monotonic()
            if sum(behind.values()) >= self.least or time.monotonic() - self.waiting_since >= self.delay:
                for p, n in shares(behind, self.most).items():
                    self.planned[p] = self.planned.get(p, 0) + n
                self.waiting_since = None
                self._keep()
        return {str(p): n for p, n in self.planned.items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for p, files in segments(self.path).items():
            low, high = start.get(str(p), 0), end.get(str(p), 0)
            out += [Stretch(path, max(low, a), min(high, b)) for a, b, path in files if a < high and low < b]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(_BATCH):
                first = batch.column("offset")[0].as_py()
                own = batch.slice(max(0, partition.low - first), max(0, partition.high - max(first, partition.low)))
                if own.num_rows:
                    yield own


def shares(behind: dict[int, int], most: int) -> dict[int, int]:
    """How many messages each partition hands over, `most` together (0: all), as even as can be."""
    if not most or sum(behind.values()) <= most:
        return dict(behind)
    out, left = {}, most
    for place, (p, n) in enumerate(sorted(behind.items(), key=lambda x: x[1])):
        out[p] = min(n, left // (len(behind) - place) or (1 if left else 0))
        left -= out[p]
    return out


def read_log(
    spark: SparkSession, path: str, from_beginning: bool = False, max_per_batch: int | None = None, min_per_batch: int | None = None,
    max_delay: float | None = None, position: str | None = None,
) -> DataFrame:
    """Stream of (key, value, partition, offset) from a log."""
    ship_package(spark)
    spark.dataSource.register(LogSource)
    options = {"path": path, "startingOffsets": "earliest" if from_beginning else "latest", "maxPerBatch": max_per_batch,
               "minPerBatch": min_per_batch, "maxDelay": max_delay, "position": position}
    return spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items() if v is not None}).load()
