"""Nearest neighbours by multi-index hashing over learned binary codes.

* **Codes.** On a bounded sample the principal directions are found and rotated by iterative quantisation, so that the signs
  of the rotated components keep as much of a vector as they can; several rotations are learned until there are `bits` signs.
* **Radius.** A few calibration vectors (out of the sample) are compared exactly with ALL rows. The radius is the least number
  of differing bits that holds the share `covered` of their true neighbours, so it follows the whole table, not the sample.
* **Index.** Every row is indexed. Rows are packed into chunks of `chunk_rows` where they are read, without a shuffle; a
  chunk holds ids, codes and vectors. Codes are cut into substrings of 16 bits and each substring of a chunk is an index: its
  distinct values, sorted, with the rows of each.
* **Search.** Codes that differ in at most R bits differ in at most t_j bits of some substring j, if the numbers t_j + 1
  together exceed R. For every substring the values within t_j bits are looked up, by listing the bit patterns or by walking
  over the distinct values, whichever are fewer. The rows found are all rows within R and some more; the full code decides,
  then the exact distance of the original vectors. A pair of chunk and block of queries gives at most `k` rows a query.
* **Widening.** Queries that found fewer than `k` rows search again with twice the radius, up to all bits, when every row is
  found. So a query has fewer than `k` rows only if there are no more.

Queries are packed into blocks of `block_rows` and meet the chunks by an equi-join on a slot: a chunk is in one of `slots`, a
block in all of them. Chunks are never copied, no task holds more than a few chunks and blocks, and groups of equal rows or
codes spread over chunks like any others. What is learned and collected has a bound: `sample_rows` vectors of at most
`sample_values` numbers together, and `calibration` x `k` neighbours.

Odd cases: vectors that are null, all zero, or hold null, NaN or infinite components take no part, nor do vectors of another
length than the most frequent one (the longest of equals). Rows with the id of the query are never its neighbours, so a repeated
row does not find itself; each of them is searched and has its own result. Rows without an id are no queries, but found like
others; they come last among equals. Equal distances are ordered by id. Empty tables and tables without queries give no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crowdlens.llm import frames
from crowdlens.session import stage

RESULT = "query_id long, rank int, vec_id long, score double"
SUBSTRING = 16
_ONES = np.array([bin(value).count("1") for value in range(1 << SUBSTRING)], np.uint8)
#: All values of a substring by their number of ones, and how many have at most so many.
_BY_ONES = np.argsort(_ONES, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_ONES))


@dataclass(frozen=True)
class Settings:
    k: int = 10
    bits: int = 128
    covered: float = 0.97
    calibration: int = 64
    sample_rows: int = 10_000
    sample_values: int = 4_000_000
    chunk_rows: int = 8_192
    block_rows: int = 512
    slots: int = 48
    rounds: int = 30


# ---------------------------------------------------------------- codes

@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    directions: np.ndarray  # dimensions x bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of substrings, the last one filled up with zeros."""
        signs = np.zeros((len(vectors), -(-self.directions.shape[1] // SUBSTRING) * SUBSTRING), bool)
        signs[:, : self.directions.shape[1]] = (vectors - self.mean) @ self.directions > 0
        return np.packbits(signs, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, settings: Settings) -> Codes:
    """Principal directions of the sample, rotated so that signs lose little; one rotation after another."""
    # Components of any size: lengths are brought near 1 before squares are taken.
    scale = max(float(np.abs(sample).max(initial=0.0)), 1e-300)
    mean = (sample / scale).mean(axis=0) * scale
    centred = (sample - mean) / scale
    width = min(sample.shape[1], settings.bits)
    _, _, axes = np.linalg.svd(centred.T @ centred / max(len(sample), 1))
    axes = axes[:width].T
    projected = centred @ axes
    rng = np.random.default_rng(13)
    found = []
    while sum(part.shape[1] for part in found) < settings.bits:
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(settings.rounds):
            signs = np.where(projected @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        found.append(axes @ rotation)
    return Codes(mean, np.concatenate(found, axis=1)[:, : settings.bits])


def differing(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _ONES[codes ^ code].sum(axis=1, dtype=np.int64)


def thresholds(radius: int, substrings: int) -> list[int]:
    """Bits by which each substring may differ (-1: not looked up), as even as can be with sum(t + 1) = radius + 1."""
    each, more = divmod(radius + 1, substrings)
    return [each - 1 + (j < more) for j in range(substrings)]


# ---------------------------------------------------------------- the index of a chunk

class Chunk:
    """Ids, codes and vectors of some rows, and for each substring its distinct values with their rows."""

    def __init__(self, ids: pa.Array, codes: np.ndarray, vectors: np.ndarray):
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.codes, self.vectors = codes, vectors
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((order, values, np.append(first, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from `code` in at most `radius` bits."""
        found = np.zeros(len(self.codes), bool)
        for (order, values, bounds), own, most in zip(self.tables, code, thresholds(radius, len(code))):
            if most < 0:
                continue
            if most >= SUBSTRING:
                found[:] = True
                break
            if _WITHIN[most] < len(values):
                probes = _BY_ONES[: _WITHIN[most]] ^ own
                at = np.searchsorted(values, probes)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
            else:
                at = np.flatnonzero(_ONES[values ^ own] <= most)
            size = bounds[at + 1] - bounds[at]
            begin = np.repeat(bounds[at] - (np.cumsum(size) - size), size)
            found[order[begin + np.arange(len(begin))]] = True
        rows = np.flatnonzero(found)
        return rows[differing(self.codes[rows], code) <= radius]

    def nearest(self, rows: np.ndarray, vector: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of `rows` without the id `own`, and their distances."""
        rows = rows[(self.ids[rows] != own) | ~self.known[rows]]
        gap = self.vectors[rows] - vector
        largest = np.abs(gap).max(axis=1, initial=0.0)
        scale = np.where((largest > 1e100) | (largest < 1e-100), np.maximum(largest, 1e-300), 1.0)
        gap /= scale[:, None]
        score = np.sqrt((gap * gap).sum(axis=1)) * scale
        if len(rows) > k:
            near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])  # with all that equal the k-th
            rows, score = rows[near], score[near]
        order = np.lexsort((self.ids[rows], ~self.known[rows], score))[:k]
        return rows[order], score[order]


# ---------------------------------------------------------------- packing rows

_PACKED = "part long, slot int, ids array<long>, codes binary, vectors binary"


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _pack_task(codes: Codes, rows: int, slots: int):
    """Rows (vec_id, vector) to chunks; `part` numbers them within the whole table."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held, count = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _matrix(table["vector"].combine_chunks(), len(codes.mean))
            number += 1
            slot = (number * 0x9E3779B97F4A7C15 >> 32) % slots
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([slot], pa.int32()), pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
                 pa.array([codes.of(vectors).tobytes()]), pa.array([vectors.tobytes()])],
                names=["part", "slot", "ids", "codes", "vectors"])
        for batch in batches:
            while batch.num_rows:
                room = batch.slice(0, rows - count)
                held.append(room)
                count += room.num_rows
                batch = batch.slice(room.num_rows)
                if count == rows:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()
    return task


def _unpacked(batch: pa.RecordBatch, row: int, prefix: str, codes: Codes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids = batch.column(prefix + "ids")[row].values
    code = np.frombuffer(batch.column(prefix + "codes")[row].as_py(), np.uint16).reshape(len(ids), -1)
    return ids, code, np.frombuffer(batch.column(prefix + "vectors")[row].as_py(), np.float64).reshape(len(ids), -1)


def packed(rows: DataFrame, codes: Codes, chunk_rows: int, slots: int) -> DataFrame:
    return frames.map_rows(rows, _pack_task(codes, chunk_rows, slots), _PACKED)


# ---------------------------------------------------------------- search

_FOUND = "block long, place int, query_id long, vec_id long, score double"


def _search_task(codes: Codes, radius: int, k: int):
    """Pairs of a chunk and a block of queries to the best k rows of the chunk for each query."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column("part")[row].as_py()
                if part != last:
                    last, chunk = part, Chunk(*_unpacked(batch, row, "", codes))
                queries, code, vectors = _unpacked(batch, row, "q_", codes)
                places, found, scores = [], [], []
                for place, own in enumerate(queries.to_pylist()):
                    rows, score = chunk.nearest(chunk.within(code[place], radius), vectors[place], own, k)
                    places.append(np.full(len(rows), place, np.int32))
                    found.append(rows)
                    scores.append(score)
                place, rows = np.concatenate(places), np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), batch.column("q_part")[row].as_py())), pa.array(place), queries.take(pa.array(place)),
                     pa.array(chunk.ids[rows], mask=~chunk.known[rows]), pa.array(np.concatenate(scores))],
                    names=["block", "place", "query_id", "vec_id", "score"])
    return task


def _search(chunks: DataFrame, blocks: DataFrame, codes: Codes, radius: int, settings: Settings) -> DataFrame:
    """(block, place, query_id, vec_id, score, rank) of the best k rows within `radius` for each query, staged."""
    spark = chunks.sparkSession
    asked = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(settings.slots - 1))).alias("slot"),
        F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), F.col("vectors").alias("q_vectors"))
    pairs = chunks.join(asked, "slot")
    found = frames.map_rows(pairs, _search_task(codes, radius, settings.k), _FOUND)
    best = W.partitionBy("block", "place").orderBy("score", F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.k)
    # A pair is a few MB, so few of them go to Python at once.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "4")
    try:
        return stage(ranked, "near-vectors")
    finally:
        spark.conf.set(rows, before)


def usable(rows: DataFrame, vector: str, id_: str) -> DataFrame:
    """vec_id and components (as doubles) of the vectors that take part."""
    value = F.col(vector)
    numbers = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(value, lambda x: x != 0)
    found = rows.where(value.isNotNull() & numbers & some).select(
        F.col(id_).cast("long").alias("vec_id"), F.transform(value, lambda x: x.cast("double")).alias("vector"))
    length = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return found.where(F.size("vector") == (length["n"] if length else 0))


def _sample(rows: DataFrame, settings: Settings) -> np.ndarray:
    """At most `sample_rows` different vectors, those of the smallest hashes; fewer, if they are long."""
    marked = rows.withColumn("mark", F.xxhash64("vector"))
    first = rows.select(F.size("vector")).head()
    if first is None:
        return np.zeros((0, 0))
    wanted = max(2, min(settings.sample_rows, settings.sample_values // first[0]))
    marks = marked.select("mark").distinct().orderBy("mark").limit(wanted)
    last = marks.agg(F.max("mark")).head()[0]
    chosen = marked.where(F.col("mark") <= last).dropDuplicates(["mark"]).orderBy("mark").select("vector").toArrow()
    return _matrix(chosen["vector"].combine_chunks(), first[0])


def _near_task(codes: Codes, asked: np.ndarray, k: int):
    """The k nearest rows of a task to each of the `asked` vectors, with the differing bits; equal vectors are not counted."""
    wanted = codes.of(asked)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = [np.zeros(0)] * len(asked)
        bits = [np.zeros(0, np.int64)] * len(asked)
        for batch in batches:
            vectors = _matrix(batch.column("vector"), len(codes.mean))
            own = codes.of(vectors)
            for i, vector in enumerate(asked):
                gap = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
                near = np.flatnonzero(gap > 0)
                if len(near) > k:
                    near = near[np.argpartition(gap[near], k - 1)[:k]]
                gap, apart = np.append(score[i], gap[near]), np.append(bits[i], differing(own[near], wanted[i]))
                order = np.argsort(gap, kind="stable")[:k]
                score[i], bits[i] = gap[order], apart[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(asked)), [len(x) for x in score])), pa.array(np.concatenate([*score, np.zeros(0)])),
             pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]).astype(np.int64))], names=["asked", "score", "bits"])
    return task


def radius(rows: DataFrame, codes: Codes, sample: np.ndarray, settings: Settings) -> int:
    """Least number of bits that holds the share `covered` of the true neighbours of the calibration vectors."""
    asked = sample[:: max(1, len(sample) // settings.calibration)][: settings.calibration]
    found = frames.map_rows(rows.select("vector"), _near_task(codes, asked, settings.k), "asked long, score double, bits long")
    best = W.partitionBy("asked").orderBy("score", "bits")
    bits = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= settings.k).select("bits").toArrow()["bits"].to_numpy()
    return int(np.quantile(bits, settings.covered, method="higher")) if len(bits) else settings.bits


def search(rows: DataFrame, queries: Column, settings: Settings = Settings(), vector: str = "embedding",
           id_: str = "vec_id") -> DataFrame:
    """The `k` nearest rows found (RESULT) for each row of `rows` whose id satisfies the condition `queries` on `vec_id`."""
    spark = rows.sparkSession
    vectors = stage(usable(rows, vector, id_), "vectors")
    sample = _sample(vectors, settings)
    if not len(sample):
        return spark.createDataFrame([], RESULT)
    codes = learn(sample, settings)
    within = radius(vectors, codes, sample, settings)
    chunks = stage(packed(vectors, codes, settings.chunk_rows, settings.slots), "vector-chunks")
    waiting = vectors.where(queries & F.col("vec_id").isNotNull())
    done = None
    while True:
        blocks = stage(packed(waiting, codes, settings.block_rows, 1), "query-blocks")
        found = _search(chunks, blocks, codes, within, settings)
        full = found.where(F.col("rank") == settings.k).select("block", "place")
        if within >= settings.bits:
            done = found if done is None else done.unionByName(found)
            break
        enough = found.join(full, ["block", "place"], "left_semi")
        done = enough if done is None else done.unionByName(enough)
        asked = blocks.select(F.col("part").alias("block"), F.posexplode("ids").alias("place", "query_id"), "vectors")
        size = 8 * len(codes.mean)
        left = asked.join(full, ["block", "place"], "left_anti").select(
            F.col("query_id").alias("vec_id"), F.substring("vectors", F.col("place") * size + 1, F.lit(size)).alias("vector"))
        if not left.limit(1).count():
            break
        waiting = frames.map_rows(left, _unpack_task(len(codes.mean)), "vec_id long, vector array<double>")
        within = min(2 * within + 1, settings.bits)
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpack_task(dimensions: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.FixedSizeListArray.from_arrays(pa.array(flat), dimensions).cast(pa.list_(pa.float64()))],
                names=["vec_id", "vector"])
    return task
